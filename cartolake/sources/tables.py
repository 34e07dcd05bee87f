"""The domain's relations, derived from the benchmark tables by one SQL text each that Spark and other engines share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Relation name to (base tables, SQL over them). Distances: a 0.2 degree square over the Bosphorus.
RELATIONS: dict[str, tuple[tuple[str, ...], str]] = {
    "cities": (
        ("nation",),
        """SELECT CAST(n_nationkey AS BIGINT) AS city_id, n_name AS name, n_regionkey AS region_id,
           40.9e0 + floor(n_nationkey / 5.0e0) * 0.04e0 AS south, 40.94e0 + floor(n_nationkey / 5.0e0) * 0.04e0 AS north,
           29.0e0 + (n_nationkey % 5) * 0.04e0 AS west, 29.04e0 + (n_nationkey % 5) * 0.04e0 AS east FROM nation""",
    ),
    "districts": (
        ("supplier",),
        """SELECT s_suppkey AS district_id, s_name AS name, CAST(s_nationkey AS BIGINT) AS city_id, s_acctbal AS weight,
           40.9e0 + (s_suppkey % 20) * 0.01e0 AS south, 40.91e0 + (s_suppkey % 20) * 0.01e0 AS north,
           29.0e0 + (s_suppkey % 10) * 0.02e0 AS west, 29.02e0 + (s_suppkey % 10) * 0.02e0 AS east FROM supplier""",
    ),
    "places": (
        ("part",),
        """SELECT p_partkey AS place_id, p_name AS name, p_partkey % 25 AS city_id,
           CASE p_size % 10 WHEN 0 THEN 'RESTAURANT' WHEN 1 THEN 'CAFE' WHEN 2 THEN 'MUSEUM' WHEN 3 THEN 'PARK' WHEN 4 THEN 'MARKET'
             WHEN 5 THEN 'WORSHIP' WHEN 6 THEN 'ATTRACTION' WHEN 7 THEN 'BAR' WHEN 8 THEN 'SHOPPING' ELSE 'VIEWPOINT' END AS category,
           CASE WHEN p_size % 5 = 0 THEN NULL ELSE 3.0e0 + (p_size % 20) / 10.0e0 END AS rating,
           CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size * 25 END AS cost,
           40.9e0 + ((p_partkey * 7919) % 2000) / 10000.0e0 AS lat, 29.0e0 + ((p_partkey * 104729) % 2000) / 10000.0e0 AS lon,
           p_size % 11 = 0 AS hidden, p_size % 13 = 0 AS unconfirmed, p_partkey % 17 = 0 AS inside_institution,
           CASE WHEN p_partkey % 23 = 0 THEN 'REMOVED' END AS review,
           CASE p_partkey % 4 WHEN 0 THEN 'OSM' WHEN 1 THEN 'OVERTURE' WHEN 2 THEN 'VERIFIED' ELSE 'OSM' END AS source,
           p_partkey % 2 = 0 AS indoor, p_partkey % 3 = 0 AS has_image, p_type AS kind, p_brand AS brand,
           p_retailprice AS popularity, split(p_name, ' ') AS tags FROM part""",
    ),
    "opening_hours": (
        ("part",),
        """SELECT p_partkey AS place_id, d.day AS day, (8 + p_size % 4) * 60 AS opens, ((20 + p_size % 8) * 60) % 1440 AS closes
           FROM part CROSS JOIN (SELECT 1 AS day UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5
           UNION ALL SELECT 6 UNION ALL SELECT 7) d WHERE p_size % 9 <> 0""",
    ),
    "users": (("customer",), "SELECT c_custkey AS user_id, c_name AS name, c_mktsegment AS segment, c_acctbal AS balance FROM customer"),
    "routes": (
        ("orders",),
        """SELECT o_orderkey AS route_id, o_custkey AS user_id, CAST(o_orderdate AS DATE) AS day, o_totalprice AS budget,
           CASE o_orderstatus WHEN 'F' THEN 'DONE' WHEN 'O' THEN 'ACTIVE' ELSE 'DRAFT' END AS status, o_orderkey % 3 = 0 AS saved FROM orders""",
    ),
    "route_stops": (
        ("lineitem",),
        """SELECT l_orderkey AS route_id, l_linenumber AS position, min(l_partkey) AS place_id, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) = 1 AS skipped
           FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    ),
    "place_ratings": (
        ("lineitem", "orders"),
        """SELECT l_partkey AS place_id, o_custkey AS user_id, max(1 + CAST(floor(l_quantity) AS INT) % 5) AS stars, max(o_orderdate) AS updated_at
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey, o_custkey""",
    ),
    "rating_reasons": (
        ("lineitem", "orders"),
        "SELECT DISTINCT l_partkey AS place_id, o_custkey AS user_id, l_linenumber AS reason FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    ),
    "saved_places": (
        ("lineitem", "orders"),
        "SELECT DISTINCT o_custkey AS user_id, l_partkey AS place_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linestatus = 'O'",
    ),
    "route_feedback": (
        ("orders",),
        "SELECT o_orderkey AS route_id, o_orderpriority NOT LIKE '5%' AS liked, o_orderdate AS updated_at FROM orders WHERE o_orderkey % 2 = 0",
    ),
    "usage": (
        ("events",),
        "SELECT event_id, ts AS created_at, user_id, event_type AS kind, event_type <> 'error' AS ok, value AS cost, props FROM events",
    ),
    "reports": (("events",), "SELECT event_id AS report_id, event_id % 97 AS place_id, event_type AS reason, ts AS created_at, value < 100 AS resolved FROM events"),
    "messages": (("conversations",), "SELECT conv_id, turn AS id, role, text AS content FROM conversations"),
    "elements": (
        ("part",),
        """SELECT p_partkey AS element_id,
           CASE p_partkey % 12 WHEN 0 THEN 'cafe' WHEN 1 THEN 'restaurant' WHEN 2 THEN 'fast_food' WHEN 3 THEN 'place_of_worship' WHEN 4 THEN 'marketplace' WHEN 5 THEN 'theatre' END AS amenity,
           CASE p_partkey % 12 WHEN 6 THEN 'bakery' WHEN 7 THEN 'supermarket' WHEN 8 THEN 'coffee' END AS shop,
           CASE p_partkey % 12 WHEN 9 THEN 'museum' WHEN 10 THEN 'viewpoint' END AS tourism,
           CASE WHEN p_partkey % 12 = 11 THEN CASE WHEN p_size % 3 = 0 THEN 'garden' ELSE 'park' END END AS leisure,
           CASE WHEN p_size % 7 = 0 THEN 'castle' END AS historic, CASE WHEN p_size % 13 = 0 THEN 'private' END AS access,
           CASE WHEN p_size % 11 = 0 THEN 'yes' END AS disused, CASE WHEN p_size % 19 = 0 THEN 'closed' END AS status,
           CASE WHEN p_size % 17 = 0 THEN 'off' WHEN p_size % 8 = 0 THEN 'Mo-Fr 09:00-18:00' END AS hours,
           CASE WHEN p_retailprice < 930 THEN 'low' ELSE 'high' END AS confidence, lower(replace(p_brand, 'Brand#', 'b')) AS brand,
           CASE WHEN p_partkey % 29 = 0 THEN 'Q1' END AS wikidata, CASE WHEN p_partkey % 31 = 0 THEN 'https://example.org' END AS website,
           CASE p_size % 9 WHEN 0 THEN 'tea' WHEN 1 THEN 'ice_cream' WHEN 2 THEN 'kebab;doner' WHEN 3 THEN 'pizza' END AS cuisine,
           CASE CAST(floor(p_partkey / 12.0e0) AS INT) % 24 WHEN 0 THEN 'Okul Kantini' WHEN 1 THEN concat('Çay Bahçesi ', p_name) WHEN 2 THEN 'kafe' WHEN 3 THEN concat('"', p_name, ' Ekmek Fırını"')
             WHEN 4 THEN 'YILDIZ MARKET' WHEN 5 THEN 'Ada Eczanesi' WHEN 6 THEN 'Emniyet Sosyal Tesisleri' WHEN 7 THEN concat(p_name, ' Pansiyon') WHEN 8 THEN 'Kapalı Çarşı'
             WHEN 9 THEN 'eski caminin bulunduğu yer' WHEN 10 THEN '  Çiğ   Köfte  ' WHEN 11 THEN 'Işık Kıraathanesi' WHEN 12 THEN 'Simit Sarayı ve Kahve' WHEN 13 THEN 'Üsküdar'
             WHEN 14 THEN 'BEŞİKTAŞ BALIK EVİ' WHEN 15 THEN '42' WHEN 16 THEN CAST(NULL AS STRING) WHEN 17 THEN '' WHEN 18 THEN 'Hayvan Pazarı' WHEN 19 THEN 'Nargile, bilardo, çay, kahve ve daha fazlası burada bulunmaktadır'
             WHEN 20 THEN concat('Balıkesir ', p_name, ' Lokantası') WHEN 21 THEN 'Kadıköy Pastanesi' WHEN 22 THEN concat('Gül Sokak 5 ', p_name) ELSE p_name END AS name FROM part""",
    ),
    "areas": (
        ("nation", "supplier"),
        """SELECT 'CITY' AS kind, CAST(n_nationkey AS BIGINT) AS area_id, CAST(n_nationkey AS BIGINT) AS city_id, concat('Nation ', CAST(n_nationkey AS STRING)) AS name FROM nation
           UNION ALL SELECT 'DISTRICT', CAST(s_suppkey AS BIGINT), CAST(s_nationkey AS BIGINT),
           CASE WHEN s_suppkey % 41 = 40 THEN 'Nation 3' ELSE concat('Merkez ', CAST(s_suppkey % 40 AS STRING)) END FROM supplier""",
    ),
    "notes": (
        ("orders",),
        """SELECT note_id, city, district, here, said_day, said_area, said_wish, day, weekday, concat_ws(' ',
           CASE said_day WHEN 0 THEN 'Yarın' WHEN 1 THEN 'öbür gün' WHEN 2 THEN 'the day after tomorrow'
             WHEN 3 THEN concat(CAST(day(day) AS STRING), ' ', split_part('ocak,şubat,mart,nisan,mayıs,haziran,temmuz,ağustos,eylül,ekim,kasım,aralık', ',', CAST(month(day) AS INT)), '''de')
             WHEN 4 THEN concat(split_part('January,February,March,April,May 2026 or,June,July,August,September,October,November,December', ',', CAST(month(day) AS INT)), ' ', CAST(day(day) AS STRING), 'th, ', CAST(year(day) AS STRING))
             WHEN 5 THEN concat(lpad(CAST(day(day) AS STRING), 2, '0'), '.', lpad(CAST(month(day) AS STRING), 2, '0'), '.', CAST(year(day) AS STRING))
             WHEN 6 THEN concat(split_part('Pazartesi,Salı,Çarşamba,Perşembe,Cuma,Cumartesi,pazar', ',', CAST(weekday + 1 AS INT)), ' günü')
             WHEN 7 THEN concat('this ', split_part('Monday,Tuesday,Wednesday,Thursday,Friday,Saturday,Sunday', ',', CAST(weekday + 1 AS INT)))
             WHEN 8 THEN concat('saat 10.30, ', CAST(day(day) AS STRING), '/', CAST(month(day) AS STRING), '/', right(CAST(year(day) AS STRING), 2))
             WHEN 9 THEN concat(CAST(day(day) AS STRING), '.', lpad(CAST(month(day) AS STRING), 2, '0'), ', 2.5 km') END,
           CASE said_area WHEN 0 THEN concat('Nation ', CAST(city AS STRING), '''te gezelim') WHEN 1 THEN concat('Merkez ', CAST(district AS STRING), ' tarafında')
             WHEN 2 THEN concat('NATION ', CAST(city AS STRING), ' merkez ', CAST(district AS STRING), '''de kahve') WHEN 3 THEN concat('Nation ', CAST(city AS STRING), ' and Nation ', CAST((city + 1) % 25 AS STRING), ' tour') END,
           CASE said_wish WHEN 0 THEN 'bir gün planla' WHEN 1 THEN 'daha ucuz olsun' WHEN 2 THEN 'ikinci durağı sil' WHEN 3 THEN 'hava nasıl olacak' WHEN 4 THEN 'Merhaba' WHEN 5 THEN 'bütçem 1500 TL' ELSE '4 kişi için plan' END) AS content
           FROM (SELECT CAST(o_orderkey AS BIGINT) AS note_id, o_custkey % 25 AS city, o_custkey % 40 AS district, o_orderkey % 23 AS here, o_orderkey % 11 AS said_day, o_orderkey % 5 AS said_area, o_orderkey % 7 AS said_wish,
             DATE '2026-05-02' + CAST(o_custkey % 200 AS INT) AS day, o_custkey % 7 AS weekday FROM orders) n""",
    ),
    "asks": (
        ("orders",),
        """SELECT ask_id, n, amount, p, b, s, d, w, concat_ws(' ', CASE p WHEN 0 THEN concat(CAST(n AS STRING), ' kişi') WHEN 1 THEN 'iki kişiyiz,' WHEN 2 THEN 'Eşimle' WHEN 3 THEN 'on iki kişilik grup' WHEN 4 THEN concat('for ', CAST(n AS STRING), ' people') END,
           CASE b WHEN 0 THEN concat(CAST(amount AS STRING), ' TL') WHEN 1 THEN 'bütçemiz iki bin beş yüz lira' WHEN 2 THEN 'budget is 3k.' WHEN 3 THEN 'bin lira' END,
           CASE s WHEN 0 THEN 'saat 14.30''da' WHEN 1 THEN 'at 3 pm' WHEN 2 THEN 'öğleden sonra' WHEN 3 THEN 'sabah' END,
           CASE d WHEN 0 THEN 'üç saatlik' WHEN 1 THEN 'yarım gün' WHEN 2 THEN 'for 2 hours' END, CASE w WHEN 0 THEN 'az yürüyelim' WHEN 1 THEN 'uzun bir yürüyüş' END) AS content
           FROM (SELECT CAST(o_orderkey AS BIGINT) AS ask_id, 1 + o_custkey % 9 AS n, 100 * (1 + o_orderkey % 40) AS amount, o_custkey % 6 AS p, o_orderkey % 5 AS b, o_custkey % 5 AS s, o_orderkey % 4 AS d, o_orderkey % 3 AS w FROM orders) q""",
    ),
    # Rules for kinds of food places: a brand and a word, heavier ones first, with the share of the brand's rows that have the word.
    "kind_rules": (
        ("part",),
        """SELECT row_number() OVER (ORDER BY n DESC, brand, word) AS rule, concat('KIND_', upper(word), '_', right(brand, 1)) AS outcome, brand, word, n AS weight, round(n * 1.0e0 / sum(n) OVER (PARTITION BY brand), 6) AS confidence
           FROM (SELECT lower(replace(p_brand, 'Brand#', 'b')) AS brand, split_part(p_name, ' ', 1) AS word, count(*) AS n FROM part GROUP BY 1, 2
           UNION ALL SELECT lower(replace(p_brand, 'Brand#', 'b')), split_part(p_name, ' ', 2), count(*) FROM part GROUP BY 1, 2) k""",
    ),
    "photos": (("labels",), "SELECT doc_id AS photo_id, doc_id % 200 AS place_id, quality, toxic FROM labels"),
}

#: Relations that each derived relation needs none of; base tables by name are available too.
BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Tables:
    """Lazy DataFrames of the base tables and the derived relations under one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in RELATIONS:
            needed, text = RELATIONS[name]
            frames = {t: getattr(self, t) for t in needed}
            for t in needed:
                text = _argument(text, t)
            return self.spark.sql(text, **frames)
        if name in BASE:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        raise AttributeError(name)


def _argument(text: str, table: str) -> str:
    """Names a table as an argument of spark.sql()."""
    return text.replace(f"FROM {table}", f"FROM {{{table}}}").replace(f"JOIN {table} ", f"JOIN {{{table}}} ")


def with_relations(*names: str) -> str:
    """The relations as common table expressions, for engines that only know the base tables."""
    return "WITH " + ", ".join(f"{n} AS ({RELATIONS[n][1]})" for n in names) + " "
