"""Source divergence audit against plain sums, over several rounds, blocks and teams."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from offerloom.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, place string, n long"


def plain(docs, least, top):
    counts, groups, held = defaultdict(Counter), set(), defaultdict(Counter)
    for lang, source, text in docs:
        lang, source, terms = lang or "", source or "", [t.translate(LOWER) for t in TERM.findall(text or "")]
        groups.add((lang, source))
        counts[lang, source].update(terms)
        held[lang].update(set(terms))
    out = []
    kept = {lang: sorted(t for t, n in c.items() if n >= least) for lang, c in held.items()}
    shares = {}
    for g in [*groups, *{(lang, None) for lang, _ in groups}]:
        c = counts[g] if g[1] is not None else sum((counts[h] for h in groups if h[0] == g[0]), Counter())
        terms = kept.get(g[0], [])
        over = sum(c[t] for t in terms) + 5 * len(terms)
        shares[g] = {t: 1 + 1_000_000_000 * (c[t] + 5) // over for t in terms}
    for lang, source in groups:
        p = shares[lang, source]
        pairs = [(other, sum(abs(p[t] - shares[lang, other][t]) for t in p)) for at, other in groups if at == lang and other != source]
        ahead = [(t, p[t] - shares[lang, None][t]) for t in p if counts[lang, source][t] and p[t] > shares[lang, None][t]]
        for part, rows in (("pair", pairs), ("term", ahead)):
            rows.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, k) for k, (item, value) in enumerate(rows, 1) if part == "pair" or k <= top]
    return Counter(out)


def made(seed, sources, rows):
    rng = random.Random(seed)
    words = [rng.choice("abcdefgéßñ日") + rng.choice("klmnoü") + rng.choice(["", "x", "Y"]) for _ in range(120)]
    return [(rng.choice(["en", "fr", None]), rng.choice([None, *(f"s{k}" for k in range(sources))]) if rng.random() < 0.7 else "s0", rng.choice([None, "", "1 2 3"]) if rng.random() < 0.1 else " ".join(rng.choices(words[: rng.randrange(5, 120)], k=rng.randrange(30)))) for _ in range(rows)] + [("de", "alone", "nur ein Text"), ("xx", "a", None), ("xx", "b", "")]


@pytest.mark.parametrize("sources, block, team", [(3, 4096, 32), (23, 16, 1), (11, 7, 2)])
def test_against_plain_sums(spark, sources, block, team):
    docs = made(sources, sources, 500)
    df = spark.createDataFrame([(k, text, lang, source, "own", 1) for k, (lang, source, text) in enumerate(docs)], SCHEMA)
    got = D.audit(df, least_docs=5, top=6, block_terms=block, team=team)
    assert Counter(tuple(r) for r in got.collect()) == plain(docs, 5, 6)


def test_every_two_teams_meet_once(spark):
    for teams in (4, 6, 10):
        met = Counter()
        for turn in range(teams - 1):
            rows = spark.range(teams).select("id", D.opponent(D.F.col("id").cast("int"), D.F.lit(teams), turn).alias("other")).collect()
            assert all(dict(rows)[o] == t for t, o in rows)
            met.update(frozenset((r.id, r.other)) for r in rows)
        assert len(met) == teams * (teams - 1) // 2 and set(met.values()) == {2}


def test_shares_are_exact_where_products_overflow():
    import numpy as np

    counts, over = [0, 7, 3_000_000_000_000_000], 8_999_999_999_999_999
    assert D.share(np.array(counts), over).tolist() == [1 + 1_000_000_000 * (c + 5) // over for c in counts]


def test_empty_table(spark):
    assert D.audit(spark.createDataFrame([], SCHEMA)).collect() == []
