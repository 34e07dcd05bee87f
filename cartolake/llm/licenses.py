"""License scans by diagonal voting, in DataFrame operations only.

Every text is cut into words and its rolling two-word grams are joined by hash to the grams of a set of templates. A match
of text place i and template place j votes for the diagonal i - j of that template. Votes are gathered by document, template
and diagonal, as the set of template places that each diagonal got; diagonals that lie close together in the text are merged
into runs. A run whose diagonals have too few different template places goes. In the others the span is verified: votes of
neighbouring diagonals (words put in or left out) must form a chain in which text place and template place both rise, and
its length is the number of template grams that the span covers. Base phrases ask for all their grams on one diagonal, and
since the joined grams are compared as words, not as hashes, such a diagonal is the phrase itself.

Templates are a table: the twelve below, or the caller's (label, text), whole license texts of any length among them. Which
places of a template voted is kept as an array of numbers of 60 bits each, so no template is too long. The grams of all templates together are
counted and held against MOST_GRAMS, within which they are broadcast; a larger table is refused. What leaves a task is
one row for each document and one for each diagonal of votes.

Defined cases: null text counts as empty and has no words; every row gives one row: rows that repeat an id are kept apart
by their text, and rows that repeat both are counted once and given out as often as they occur; only id and text are read;
whole texts are scanned.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Words by which public licenses announce themselves, with the labels that the voting adds.
TEMPLATES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "licensed under cc by 4 0": "cc-by-4.0",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
}
GRAM = 2
#: Grams of all templates together at most, some 100 bytes each; they are broadcast.
MOST_GRAMS = 500_000
#: Template places in one number.
BITS = 60
#: Votes that follow each other in a span are on diagonals at most this far apart, and at most this many words apart.
BAND, GAP = 3, 8
#: Share of a template's grams that a span must cover.
COVER = 0.85
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Gram of the row that stands for the document itself.
WHOLE = ""


def words(text: Column) -> Column:
    """Words of a text: runs of digits, letters and all other characters beyond ASCII, A-Z in lower case."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), WORD_GAP)
    return F.filter(parts, lambda w: w != "")


def template_grams(spark: SparkSession, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """hash, a, b (the gram's words), template, place, size (grams of the template), label, base; templates: (label, text)."""
    own = [(label, phrase) for phrase, label in TEMPLATES.items()] if templates is None else templates
    rows = [("", None, -1, 0, 1, "", False)]
    for t, (label, text) in enumerate([*((label, phrase) for phrase, label in BASE.items()), *own]):
        w = [x for x in re.split(WORD_GAP, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
        if len(w) < GRAM:
            raise ValueError(f"a template of {label!r} has fewer than {GRAM} words")
        rows += [(w[i], w[i + 1], t, i, len(w) - 1, label, t < len(BASE)) for i in range(len(w) - 1)]
    if len(rows) > MOST_GRAMS:
        raise ValueError(f"the templates have {len(rows)} grams, more than the {MOST_GRAMS} that are broadcast")
    table = spark.createDataFrame(rows, "a string, b string, template int, place int, size int, label string, base boolean")
    return table.withColumn("hash", F.xxhash64("a", "b"))


def templates_of(table: DataFrame, label_col: str = "label", text_col: str = "text") -> list[tuple[str, str]]:
    """(label, text) of a caller's table of templates, at most MOST_GRAMS rows."""
    found = sorted((r[0], r[1]) for r in table.select(label_col, text_col).where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).distinct().limit(MOST_GRAMS).collect())
    return found


def votes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per different (id, text), template, diagonal and part of the template with a vote: id, th (hash of the text), template,
    diagonal, part, places (bit k: template place part * BITS + k was met), count, first and last place in the text.

    Template -1 stands for the document: its count is the number of rows that repeat id and text, its last place the number
    of words.
    """
    cut = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("th"), words(docs[text_col]).alias("w"))
    # The last pair is empty: it matches template -1, and its place is the number of words.
    pairs = F.arrays_zip(F.concat("w", F.array(F.lit(WHOLE))).alias("a"), F.concat(F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))), F.array(F.lit(None).cast("string"))).alias("b"))
    each = cut.select("id", "th", F.posexplode(pairs).alias("at", "gram")).select("id", "th", "at", F.col("gram.a").alias("ga"), F.col("gram.b").alias("gb"))
    each = each.withColumn("hash", F.xxhash64("ga", "gb"))
    met = each.join(F.broadcast(template_grams(docs.sparkSession, templates)), "hash").where((F.col("ga") == F.col("a")) & F.col("gb").eqNullSafe(F.col("b")))
    return met.groupBy("id", "th", "template", (F.col("at") - F.col("place")).alias("diagonal"), F.floor(F.col("place") / BITS).cast("int").alias("part")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, place % {BITS})")).alias("places"),
        F.count("*").alias("count"),
        F.min("at").alias("first"),
        F.max("at").alias("last"),
        F.first("size").alias("size"),
        F.first("label").alias("label"),
        F.first("base").alias("base"),
    )


def chained(diagonals: Column) -> Column:
    """The longest chain of votes: struct of grams, start and end (places of its first and last gram in the text).

    diagonals: array of (diagonal, part, places). Votes are read in text order; only those of the last GAP words can go on, so that
    many are remembered, each with the longest chain that ends there. Of equally long chains the earliest counts.
    """
    bits = F.sequence(F.lit(0), F.lit(BITS - 1))
    places = lambda d: F.transform(F.filter(bits, lambda k: F.getbit(d["places"], k) == 1), lambda k: d["part"] * BITS + k)
    hits = F.flatten(F.transform(diagonals, lambda d: F.transform(places(d), lambda p: F.struct((d["diagonal"] + p).alias("at"), p.alias("place")))))
    fresh = F.struct(F.lit(0).alias("n"), F.lit(0).alias("less_start"), F.lit(0).alias("less_end"))
    none = F.struct(F.array().cast("array<struct<at:int,place:int,n:int,less_start:int>>").alias("recent"), fresh.alias("best"))

    def add(state: Column, h: Column) -> Column:
        near = F.filter(state["recent"], lambda r: r["at"] >= h["at"] - GAP)
        before = F.filter(near, lambda r: (r["at"] < h["at"]) & (r["place"] < h["place"]) & (F.abs((h["at"] - h["place"]) - (r["at"] - r["place"])) <= BAND))
        top = F.array_max(F.transform(before, lambda r: F.struct(r["n"], r["less_start"])))
        n, less_start = F.coalesce(top["n"], F.lit(0)) + 1, F.coalesce(top["less_start"], -h["at"])
        mine = F.struct(h["at"].alias("at"), h["place"].alias("place"), n.alias("n"), less_start.alias("less_start"))
        best = F.array_max(F.array(state["best"], F.struct(n.alias("n"), less_start.alias("less_start"), (-h["at"]).alias("less_end"))))
        return F.struct(F.concat(near, F.array(mine)).alias("recent"), best.alias("best"))

    return F.aggregate(F.array_sort(hits), none, add, lambda state: F.struct(state["best"]["n"].alias("grams"), (-state["best"]["less_start"]).alias("start"), (-state["best"]["less_end"]).alias("end")))


def spans(counted: DataFrame) -> DataFrame:
    """One row per run of votes: id, th, copies, n_words, template, label, base, verified, and where verified start, end, cover.

    Rows of one document stay together throughout, so one shuffle by document serves votes, merging and the result.
    """
    of_doc = Window.partitionBy("id", "th")
    counted = counted.withColumn("copies", F.max(F.when(F.col("template") == -1, F.col("count"))).over(of_doc))
    counted = counted.withColumn("n_words", F.max(F.when(F.col("template") == -1, F.col("last"))).over(of_doc).cast("long"))
    by_place = Window.partitionBy("id", "th", "template").orderBy("first", "diagonal", "part")
    before = by_place.rowsBetween(Window.unboundedPreceding, -1)
    # A base phrase's diagonal fixes where it starts, so each is a run of its own.
    fresh = F.col("base") | (F.col("first") - F.max("last").over(before) > GAP)
    runs = counted.withColumn("fresh", F.when(F.coalesce(fresh, F.lit(True)), 1).otherwise(0)).withColumn("run", F.sum("fresh").over(by_place))
    merged = runs.groupBy("id", "th", "copies", "n_words", "template", "size", "label", "base", "run").agg(
        F.sum(F.bit_count("places")).alias("met"), F.collect_list(F.struct("diagonal", "part", "places")).alias("diagonals"), F.min("first").alias("first")
    )
    # Places met twice count twice here, so this only spares the chain; what the chain covers decides.
    enough = F.col("met") >= F.col("size") * F.when(F.col("base"), 1.0).otherwise(COVER)
    whole = F.struct(F.col("size").alias("grams"), F.col("first").alias("start"), (F.col("first") + F.col("size") - 1).alias("end"))
    chain = F.when((F.col("template") >= 0) & enough, F.when(F.col("base"), whole).otherwise(chained(F.col("diagonals"))))
    found = merged.withColumn("chain", chain).withColumn("cover", F.col("chain.grams") / F.col("size"))
    verified = F.coalesce(F.when(F.col("base"), F.col("cover") == 1.0).otherwise(F.col("cover") >= COVER), F.lit(False))
    return found.select("id", "th", "copies", "n_words", "template", "label", "base", verified.alias("verified"), F.col("chain.start").alias("start"), (F.col("chain.end") + GRAM).alias("end"), "cover")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans of every document.

    spans: label, base, start, end (words, end exclusive) and cover of what was verified, by start; of each run of votes the
    longest chain. score: the best cover. templates: (label, text), of any length; those of this module by default.
    """
    found = spans(votes(docs, id_col, text_col, templates))
    base = F.col("verified") & F.col("base")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    out = found.groupBy("id", "th", "copies", "n_words").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("verified")).alias("labels"),
        F.coalesce(F.max(F.when(F.col("verified"), F.col("cover"))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("verified"), F.struct("start", "end", "label", "base", "cover")))).alias("spans"),
    )
    each = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")


def oracle() -> str:
    """The query's rows in SQL: base phrases by comparing slices of the words, the rest by chains of grams, one gram longer at each step."""
    grams = [f"('{w[i]}', '{w[i + 1]}', {t}, {i}, {len(w) - 1}, '{label}')" for t, (phrase, label) in enumerate(TEMPLATES.items()) for w in [phrase.split()] for i in range(len(w) - 1)]
    phrases = [f"('{label}', [{', '.join(repr(w) for w in phrase.split())}])" for phrase, label in BASE.items()]
    return f"""
        WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        g AS MATERIALIZED (SELECT rid, i - 1 AS pos, w[i] AS a, w[i + 1] AS b FROM (SELECT rid, w, unnest(range(1, len(w))) AS i FROM d) x),
        t(a, b, template, place, size, label) AS (VALUES {', '.join(grams)}),
        p(label, ws) AS (VALUES {', '.join(phrases)}),
        h AS MATERIALIZED (SELECT rid, template, size, label, pos, place FROM g JOIN t USING (a, b)),
        c AS (SELECT rid, template, size, label, pos, place, 1 AS n FROM h
              UNION SELECT h.rid, h.template, h.size, h.label, h.pos, h.place, c.n + 1 FROM c JOIN h ON h.rid = c.rid AND h.template = c.template
              AND h.pos > c.pos AND h.pos - c.pos <= {GAP} AND h.place > c.place AND abs((h.pos - h.place) - (c.pos - c.place)) <= {BAND}),
        v AS (SELECT rid, label, max(n::DOUBLE / size) AS cover FROM c WHERE n::DOUBLE / size >= {COVER}e0 GROUP BY rid, label),
        b AS (SELECT g.rid, label, pos FROM g JOIN p ON g.a = ws[1] AND g.b = ws[2] JOIN d ON g.rid = d.rid AND w[pos + 1 : pos + len(ws)] = ws),
        s AS (SELECT rid, label, pos, 1.0e0 AS cover, TRUE AS base FROM b UNION ALL SELECT rid, label, NULL, cover, FALSE FROM v),
        a AS (SELECT rid, count(*) FILTER (base) AS n_base, min(pos) FILTER (base) AS first_word, max(pos) FILTER (base) AS last_word,
              string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score FROM s GROUP BY rid)
        SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0e0) AS score FROM d LEFT JOIN a USING (rid)"""
