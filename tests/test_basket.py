"""The four published cases of the basket comparison, and the greedy mix against a plain loop."""

from __future__ import annotations

import random

from offerloom.operators import basket as B

MATCH = "basket_id long, query_index int, offer_id string, shop_id string, price long, similarity double"


def compare(spark, requests, matches, tiers=()):
    r = spark.createDataFrame([(1, i, 1) for i in range(requests)], "basket_id long, query_index int, quantity long")
    m = spark.createDataFrame([(1, *x) for x in matches], MATCH)
    s = spark.createDataFrame([("e1", "Shop 1", 0), ("e2", "Shop 2", 1)], "shop_id string, shop_name string, tier_set int")
    t = spark.createDataFrame(list(tiers), "tier_set int, pos int, min_value long, max_value long, cost long")
    return {k: v.collect() for k, v in B.compare(r, m, s, t).items()}


def test_ordering(spark):
    out = compare(spark, 2, [(0, "a", "e1", 1000, 0.8), (1, "b", "e1", 3000, 0.7), (0, "c", "e2", 1200, 0.75)])
    tables = sorted(out["tables"], key=lambda r: r.place)
    assert [r.shop_id for r in tables] == ["e1", "e2"] and tables[0].coverage == 2 and tables[0].total == 4000
    assert out["mix_totals"][0].total == 4000 and out["single"][0].shop_id == "e1"


def test_cap(spark):
    rows = [(0, f"e1-{i}", "e1", 1000 + 100 * i, 0.9 - 0.01 * i) for i in range(22)] + [(0, f"e2-{i}", "e2", 800 + 100 * i, 0.85 - 0.05 * i) for i in range(3)]
    top = compare(spark, 1, rows)["candidates"]
    assert sum(r.shop_id == "e1" for r in top) == 20 and sum(r.shop_id == "e2" for r in top) == 3
    assert next(r for r in top if r.shop_id == "e1" and r.place == 1).offer_id == "e1-0"


def test_floor(spark):
    out = compare(spark, 1, [(0, "x", "e1", 500, 0.05)])
    assert not out["tables"] and not out["mix"]


def test_tiers(spark):
    out = compare(spark, 1, [(0, "a", "e1", 10000, 0.8)], [(0, 0, 0, 14999, 995), (0, 1, 15000, None, 0)])
    assert out["tables"][0].shipping == 995 and out["tables"][0].total == 10995 and out["mix_totals"][0].total == 10995


def test_greedy_mix(spark):
    rng = random.Random(3)
    tiers = [(0, 0, 0, 499, 300), (0, 1, 500, None, 0), (1, 0, 0, 299, 200), (1, 1, 400, None, 50)]
    shops = [(k, f"s{k % 3}", k % 2) for k in range(5)]
    lines = [(b, q, s, rng.randint(50, 400), rng.randint(1, 2), rng.random() > 0.2) for b in range(12) for q in range(5) for s in rng.sample(range(5), 3)]
    got = B.cheapest_mix(
        spark.createDataFrame(lines, B.LINE_TYPES), spark.createDataFrame(shops, "shop_id long, shop_name string, tier_set int"), spark.createDataFrame(tiers, "tier_set int, pos int, min_value long, max_value long, cost long")
    ).collect()

    def cost(total, shop):
        return next((c for s, _, lo, hi, c in tiers if s == shop % 2 and total > 0 and total >= lo and (hi is None or total <= hi)), 0)

    want = set()
    for b in range(12):
        spent: dict[int, int] = {}
        for q in range(5):
            options = []
            for bb, qq, s, p, n, ok in lines:
                if (bb, qq) == (b, q) and ok:
                    before = spent.get(s, 0)
                    options.append((p * n + cost(before + p * n, s) - cost(before, s), f"s{s % 3}", s, p * n))
            if options:
                added, _, s, line = min(options)
                spent[s] = spent.get(s, 0) + line
                want.add((b, q, s, line, added))
    assert {tuple(r) for r in got} == want


def test_comparison_as_json(spark):
    import json

    given = {
        "prodotti_richiesti": ["guanti", "frese", "nulla"],
        "risultati_db": [
            {"query_index": 0, "id": "g1", "product_name": "Guanti", "final_price": 10.0, "ecommerce_id": "A", "similarity": 0.9},
            {"query_index": 0, "id": "g2", "product_name": "Guanti", "final_price": 8.0, "ecommerce_id": "B", "similarity": 0.9},
            {"query_index": 1, "id": "f1", "product_name": "Frese", "final_price": 5.5, "ecommerce_id": "A", "similarity": 0.8},
            {"query_index": 1, "id": "f2", "product_name": "Frese", "final_price": 1.0, "ecommerce_id": "B", "similarity": 0.1},
        ],
        "catalogo_ecommerce": [
            {"id": "A", "name": "Alfa", "shipping_tiers": [{"min_value": 0, "max_value": 12.0, "shipping_cost": 4.0}, {"min_value": 12.01, "max_value": None, "shipping_cost": 0}]},
            {"id": "B", "name": "Beta", "shipping_tiers": [{"min_value": 0, "max_value": None, "shipping_cost": 3.0}]},
        ],
    }
    rows = [("x", json.dumps(given)), ("y", json.dumps(given | {"risultati_db": []})), ("z", "no json")]
    got = {r.id: r.output and json.loads(r.output) for r in B.compared_json(spark.createDataFrame(rows, "id string, input string")).collect()}
    assert got["z"] is None and got["y"]["tabelle_ecommerce"] == [] and got["y"]["scenario_risparmio"]["prodotti_mancanti_indices"] == [0, 1, 2]
    x = got["x"]
    assert [(t["ecommerce_id"], t["prezzo_prodotti"], t["prezzo_spedizione"], t["prezzo_totale"], t["copertura"], t["copertura_totale"]) for t in x["tabelle_ecommerce"]] == [("A", 15.5, 0.0, 15.5, 2, 3), ("B", 8.0, 3.0, 11.0, 1, 3)]
    assert x["scenario_risparmio"]["prodotti_mancanti_indices"] == [2] and x["scenario_risparmio"]["copertura"] == 2
    assert x["scenario_monopolista"]["ecommerce_name"] == "Alfa" and x["prodotti_richiesti"][0] == "guanti"
