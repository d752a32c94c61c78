"""Source divergence audit: how far the sources of a language are from each other, and what sets each apart.

The terms of a text are counted per task and (lang, source) before anything is
shuffled. A language keeps the terms that enough of its documents hold, and deals them
by hash into blocks of about ``BLOCK_TERMS`` terms; its sources are dealt into teams. A
cell (lang, block, team) is one row that stays where it is: the shares of the team's
sources over the block's terms, compressed. The teams then play a round-robin tournament
by the circle method: in every round the higher team of each meeting travels to the lower
one's place, and the meeting adds up the distance of every source of one from every
source of the other, for both of them. Sources of one team meet at home. Sums over
blocks are distances over all kept terms.

What sets a source apart is ranked in a local heap per source and block; the heaps of a
source's blocks are merged.

Shares are whole numbers, 1 + floor(SCALE * (count + 5) / (N + 5 V)), by long division, so they are
exact while N + 5 V stays below 9 * 10**15 (a group of that many words); distances are exact sums.

Bounds: a cell has about ``BLOCK_TERMS`` terms of ``TEAM`` sources, whatever the number of
rows, terms or sources; a source with a third of all rows is counted where its rows lie.
Rounds are joined in waves of ``WAVE``, each wave a written table.

Cases: a null text, lang or source is the empty string; a text without terms adds none, but its
group occurs; a language without kept terms has distances of 0 and no term rows; a language
of one source has no pairs; repeated rows count each; texts are read whole; equal values go by
the item in UTF-8 order; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage, unstage, utf8

SCALE = 1_000_000_000
LEAST_DOCS = 30
TOP = 50
BLOCK_TERMS = 4096
#: Sources of a team; a language has a team for each such number of sources, four at least.
TEAM = 32
WAVE = 8
#: Entries that a task counts before it hands them on.
REMEMBER = 400_000

#: What separates terms becomes a space and A-Z lower case; all other bytes belong to terms.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

COUNTS = "lang string, source string, term string, n long, docs long"
CELLS = "lang string, block int, team int, payload binary, source string, item string, value long"
MEETING = "lang string, source string, item string, value long"


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) as far as a task could add up; a row with a null term for each group a task saw."""
    import pyarrow as pa

    def emit(groups: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in groups.items():
            rows = len(n) + 1
            terms = pa.array([*n, None], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * rows, pa.string()), pa.array([source] * rows, pa.string()), terms, pa.array([*n.values(), 0], pa.int64()), pa.array([*map(docs.__getitem__, n), 0], pa.int64())], names=["lang", "source", "term", "n", "docs"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict = defaultdict(lambda: (Counter(), Counter()))
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                for lang, source, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), utf8(part.column(2))):
                    n, docs = groups[lang, source]
                    terms = raw.translate(FOLD).split()
                    n.update(terms)
                    docs.update(set(terms))
                if sum(len(n) for n, _ in groups.values()) > REMEMBER:
                    yield from emit(groups)
                    groups.clear()
        yield from emit(groups)

    empty = F.lit("")
    return docs.select(*(F.coalesce(F.col(c).cast("string"), empty).alias(c) for c in ("lang", "source", "text"))).mapInArrow(count, COUNTS)


def share(count: np.ndarray, over: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 5) / over), a thousand at a time so that nothing overflows."""
    rest, out = count.astype("i8") + 5, np.zeros(len(count), "i8")
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // over
        rest %= over
    return out + 1


def cells(counts: DataFrame, least_docs: int, top: int, block_terms: int, team: int) -> DataFrame:
    """A staged table of one payload row per (lang, block, team), and the heaps of its sources as rows of their own."""
    import pyarrow as pa
    import zstandard

    groups = stage(counts.where("term IS NULL").select("lang", "source"), "groups")
    terms = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least_docs).drop("docs")
    terms = stage(terms, "terms")
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total")), "lang", "left").fillna(0, ["v", "lang_total"])
    teams = F.greatest(F.lit(4), 2 * F.ceil(F.col("sources") / (2 * team))).cast("int")
    langs = stage(langs.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("v") / block_terms)).cast("int")).withColumn("teams", teams), "langs")
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")
    placed = terms.join(langs.select("lang", "blocks"), "lang").select("lang", "term", "lang_n", block.alias("block"))
    placed = stage(placed.withColumn("place", F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")) - 1), "places")
    widths = placed.groupBy("lang", "block").agg(F.count(F.lit(1)).alias("width"))
    held = counts.where("term IS NOT NULL").join(placed, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n", "block", "place")
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of = F.pmod(F.xxhash64("source"), F.col("teams")).cast("int").alias("team")
    every = groups.join(totals, ["lang", "source"], "left").join(langs, "lang").select("lang", "source", F.coalesce("total", F.lit(0)).alias("n"), "lang_total", "v", of, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    every = every.join(widths, ["lang", "block"], "left")
    rows = held.join(langs.select("lang", "teams"), "lang").select("lang", "block", of, "source", "term", "place", "n", "lang_n", F.lit(None).cast("long").alias("v"))
    rows = rows.union(every.select("lang", "block", "team", "source", F.lit(None).cast("string"), F.coalesce("width", F.lit(0)).cast("int"), "n", "lang_total", "v"))

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        lang, at, who = (k.as_py() for k in key)
        own = table.column("term").is_null().to_numpy()
        heads = table.filter(pa.array(own)).to_pylist()
        number = {h["source"]: k for k, h in enumerate(heads)}
        width = heads[0]["place"]
        over = [h["n"] + 5 * h["v"] for h in heads]
        p = np.empty((len(heads), width), "<i4")
        for k in range(len(heads)):
            p[k] = share(np.zeros(1, "i8"), over[k])[0] if width else 0
        body = table.filter(pa.array(~own))
        source = np.fromiter((number[s] for s in body.column("source").to_pylist()), "i8", body.num_rows)
        place, n, lang_n = (body.column(c).to_numpy() for c in ("place", "n", "lang_n"))
        mine, words = np.empty(body.num_rows, "i8"), body.column("term").to_pylist()
        for k in range(len(heads)):
            here = source == k
            mine[here] = share(n[here], over[k])
        p[source, place] = mine
        ahead = mine - (share(lang_n, heads[0]["lang_n"] + 5 * heads[0]["v"]) if len(mine) else 0)
        best: list[tuple] = []
        for k, h in enumerate(heads):
            found = np.flatnonzero((source == k) & (ahead > 0) & (n > 0))
            for less, _, word in heapq.nsmallest(top, ((-int(ahead[i]), words[i].encode(), words[i]) for i in found)):
                best.append((h["source"], word, -less))
        payload = zstandard.ZstdCompressor(level=1).compress(repr([h["source"] for h in heads]).encode() + b"\n" + p.tobytes())
        rows = len(best) + 1
        names, items, values = zip(*[(None, None, None), *best])
        return pa.table({"lang": [lang] * rows, "block": pa.array([at] * rows, pa.int32()), "team": pa.array([who] * rows, pa.int32()), "payload": pa.array([payload, *[None] * len(best)], pa.binary()), "source": pa.array(names, pa.string()), "item": pa.array(items, pa.string()), "value": pa.array(values, pa.int64())})

    out = stage(rows.groupBy("lang", "block", "team").applyInArrow(pack, CELLS), "cells")
    most = langs.agg(F.max("teams")).first()[0] or 0
    out = out.join(F.broadcast(langs.select("lang", "teams")) if langs.count() <= 1000 else langs.select("lang", "teams"), "lang")
    unstage(groups, terms, placed)
    return out, most


def opened(payload: bytes) -> tuple[list[str], np.ndarray]:
    """The sources of a payload and their shares over the block's terms."""
    from ast import literal_eval

    import zstandard

    names, _, raw = zstandard.ZstdDecompressor().decompress(payload).partition(b"\n")
    names = literal_eval(names.decode())
    return names, np.frombuffer(raw, "<i4").reshape(len(names), -1).astype("i8")


def meet(home: bytes, away: bytes | None) -> Iterator[tuple[str, str, int]]:
    """(source, other, distance) in both directions: of one team from another, or within a team at home."""
    names, p = opened(home)
    others, q = (names, p) if away is None else opened(away)
    for i, name in enumerate(names):
        first = i + 1 if away is None else 0
        for other, value in zip(others[first:], np.abs(q[first:] - p[i]).sum(1).tolist()):
            yield name, other, value
            yield other, name, value


def meetings(pairs: DataFrame) -> DataFrame:
    """(lang, source, item, value) of rows (lang, home, away); without an away side the team meets itself."""
    import pyarrow as pa

    def play(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, home, away in zip(*(batch.column(k).to_pylist() for k in range(3))):
                rows = list(meet(home, away))
                if rows:
                    source, item, value = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows), pa.string()), pa.array(source, pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())], names=["lang", "source", "item", "value"])

    return pairs.mapInArrow(play, MEETING)


def opponent(team: Column, teams: Column, turn: int) -> Column:
    """Whom ``team`` meets in a round of the circle method over an even number of teams: the last one stays, the others' numbers add up to the round."""
    ring = teams - 1
    facing = F.pmod(F.lit(turn) - team, ring)
    # the team that would face itself meets the last one; half of the round, modulo an odd ring, is round * (teams / 2)
    alone = F.pmod(F.lit(turn) * (teams / 2).cast("int"), ring)
    return F.when(team == ring, alone).when(facing == team, ring).otherwise(facing).cast("int")


def tournament(residents: DataFrame, most: int) -> DataFrame:
    """(lang, source, item, value) summed over blocks: each two teams of a language meet in one of ``most - 1`` rounds."""
    spot = ["lang", "block", "team"]
    home = residents.select(*spot, F.col("payload").alias("home"), "teams")
    waves, results = [], meetings(residents.select("lang", F.col("payload").alias("home"), F.lit(None).cast("binary").alias("away")))
    for first in range(0, max(most - 1, 0), WAVE):
        for turn in range(first, min(first + WAVE, most - 1)):
            there = opponent(F.col("team"), F.col("teams"), turn)
            travels = residents.where(F.lit(turn) < F.col("teams") - 1).select("lang", "block", there.alias("at"), "team", F.col("payload").alias("away")).where("at < team").select("lang", "block", F.col("at").alias("team"), "away")
            results = results.union(meetings(home.join(travels.hint("merge"), spot).select("lang", "home", "away")))
        waves.append(stage(results.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "wave"))
        results = waves[0].limit(0).select("lang", "source", "item", "value")
    out = waves[0]
    for w in waves[1:]:
        out = out.union(w)
    return out.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")) if len(waves) > 1 else out


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, block_terms: int = BLOCK_TERMS, team: int = TEAM) -> DataFrame:
    """lang, source, part, item, value, rank: distances from the other sources of the language, and the terms ahead of the language."""
    counts = stage(term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    found, most = cells(counts, least_docs, top, block_terms, team)
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(w).cast("int").alias("rank")
    columns = ("lang", "source", "part", "item", "value", "rank")
    terms = found.where("payload IS NULL").select("lang", "source", F.lit("term").alias("part"), "item", "value", rank).where(F.col("rank") <= top).select(*columns)
    if not most:
        return terms
    pairs = tournament(found.where("payload IS NOT NULL"), most).select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank).select(*columns)
    return pairs.union(terms)


#: The audit in SQL for DuckDB: terms by the fixed pattern, shares in exact 128-bit arithmetic.
ORACLE = r"""
WITH doc AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
word AS (SELECT d, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM doc),
kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM word GROUP BY 1, 2 HAVING count(DISTINCT d) >= 30),
grp AS (SELECT DISTINCT lang, source FROM doc),
size AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(n) AS total FROM kept GROUP BY 1),
num AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM word SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
held AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM grp g LEFT JOIN num USING (lang, source) GROUP BY 1, 2),
p AS (SELECT h.lang, h.source, k.term, coalesce(x.n, 0) AS n, 1 + (1000000000 * (coalesce(x.n, 0) + 5)) // (h.total + 5 * s.v) AS p, 1 + (1000000000 * (k.n + 5)) // (s.total + 5 * s.v) AS q
  FROM held h JOIN kept k USING (lang) JOIN size s USING (lang) LEFT JOIN num x ON x.lang = h.lang AND x.source = h.source AND x.term = k.term),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
every AS (SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value FROM pair UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM every
QUALIFY part = 'pair' OR rank <= 50
"""
