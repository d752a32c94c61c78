"""Sources and sinks that read and write files in parts: arrays by byte ranges, dated lists, sitemaps."""

from __future__ import annotations

import json
import random
import xml.etree.ElementTree as ET
import zipfile

import pytest
from pyspark.sql import functions as F

from offerloom.sources import arrays, lists, sitemaps


@pytest.fixture
def ranges_of(spark):
    """Sets how many bytes a task reads."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def put(size: int) -> None:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield put
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("indent, size", [(None, 700), (1, 300), (None, 1 << 27)])
def test_array_with_brackets_and_escapes_in_strings(spark, tmp_path, ranges_of, indent, size):
    rng = random.Random(1)
    rows = [{"k": k, "name": "".join(rng.choice(list('a}{[],"\\é\n ')) for _ in range(rng.randrange(30))), "x": [1, {"y": "}]" * rng.randrange(3)}]} for k in range(400)]
    rows[200]["name"] = "}long,[" * 700  # over several ranges
    path = tmp_path / "a.json"
    path.write_text(json.dumps(rows, indent=indent, ensure_ascii=False))
    ranges_of(size)
    got = arrays.json_array(spark, f"file://{path}", "k int, name string, x array<string>")
    assert sorted((r.k, r.name) for r in got.collect()) == [(r["k"], r["name"]) for r in rows]
    assert (arrays.pieces(spark, f"file://{path}").select("start").distinct().count() > 20) == (size < 1000)


def test_small_arrays(spark, tmp_path):
    for k, (text, want) in enumerate([("[]", []), ("[ ]\n", []), ('[{"k":1}]\n', [1]), ('[\n{"k":1},\n{"k":2}\n]', [1, 2]), ("", [])]):
        path = tmp_path / f"{k}.json"
        path.write_text(text)
        assert sorted(r.k for r in arrays.json_array(spark, f"file://{path}", "k int").collect()) == want
    with pytest.raises(Exception, match="(?i)malformed"):
        (tmp_path / "bad.json").write_text('[{"k":1},{"k":x}]')
        arrays.json_array(spark, f"file://{tmp_path}/bad.json", "k int").collect()


def test_effect_and_cut_agree_with_a_scan():
    rng = random.Random(7)
    for _ in range(300):
        text = "".join(rng.choice(list('ab{}[],"')) for _ in range(rng.randrange(40)))
        for inside in (False, True):
            depth, string = 0, inside
            for c in text:
                string ^= c == '"'
                depth += 0 if string or c == '"' else (c in "{[") - (c in "}]")
            assert arrays.effect(text, inside) == (depth, string)


def test_names_days_and_encodings():
    assert [lists.name_score(n) for n in ("x/Lista_farmaci_equivalenti.csv", "lista_equivalenti.csv", "trasparenza.csv", "a.csv", "a.txt", "lista_equivalenti_principio_attivo.csv")] == [100, 50, 40, 10, 0, -100]
    assert lists.best(["b.csv", "A.csv", "nome_commerciale.csv"]) == "A.csv" and lists.best(["prezzo_uguale.csv"]) == "prezzo_uguale.csv" and lists.best(["x.txt"]) is None
    assert str(lists.day_of("in/2026-07-15_liste/x")) == "2026-07-15" and str(lists.day_of("Prezzo 5 Luglio 2026")) == "2026-07-05"
    assert lists.day_of("12026-07-15") is None and lists.day_of("2026-13-40") is None and lists.day_of("x") is None
    assert [lists.decoded(b) for b in ("è €".encode("cp1252"), "è €".encode("utf-8-sig"), b"\x81\xe8")] == ["è €", "è €", "\x81è"]


def test_folder_archive_and_list_of_a_day_compete(spark, tmp_path):
    def put(name, *rows):
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes("\n".join(["Codice AIC;Farmaco;Prezzo Pubblico 1 agosto 2026", *rows]).encode("cp1252"))
        return at

    put("2026-07-01_x/altro.csv", "1;no;1")
    put("2026-07-01_x/lista_equivalenti.csv", "2;sì;2,50 €", "", ";;", "3; due ;")
    put("2026-07-02/a.csv", "4;no;1")
    with zipfile.ZipFile(tmp_path / "liste_2026-07-02.zip", "w") as z:
        z.writestr("in/principio_attivo.csv", "AIC\n9")
        z.writestr("in/trasparenza.csv", "AIC,Farmaco\n5,\"con, virgola\"\n")
        z.writestr("leggimi.txt", "x")
    put("senza/giorno.csv", "6;oggi;3")
    found = lists.lists(spark, f"file://{tmp_path}")
    assert sorted((str(r.day), r.member.rsplit("/", 1)[-1], r.score) for r in found.collect()) == [("2026-07-01", "lista_equivalenti.csv", 50), ("2026-07-02", "trasparenza.csv", 40), ("2026-08-01", "giorno.csv", 10)]
    rows = lists.list_rows(found, {"aic": "aic", "code": "codice aic", "medicine": "farmaco", "price": "prezzo pubblico", "none": "nota"})
    assert sorted((str(r.day), r.line, r.code, r.aic, r.medicine, r.price, r.none) for r in rows.collect()) == [("2026-07-01", 1, "2", None, "sì", "2,50 €", None), ("2026-07-01", 4, "3", None, "due", None, None), ("2026-07-02", 1, None, "5", "con, virgola", None, None), ("2026-08-01", 1, "6", None, "oggi", "3", None)]
    (tmp_path / "undated.csv").write_text("AIC\n1\n")
    with pytest.raises(ValueError, match="undated"):
        lists.lists(spark, f"file://{tmp_path}")


def test_sitemap_files_and_index(spark, tmp_path):
    path = f"file://{tmp_path}/map"
    urls = lambda n: spark.range(n).select((F.col("id") % 5).cast("int").alias("chunk"), F.concat(F.lit("https://x.org/?a=<&>'\"é"), F.col("id").cast("string")).alias("loc"))
    sitemaps.write_sitemap(urls(103), path, "https://x.org/")
    assert sorted(map(tuple, sitemaps.read_sitemap(spark, path).collect())) == [(k, 21 if k < 3 else 20, True) for k in range(5)]
    files = {p.name: ET.parse(p).getroot() for p in (tmp_path / "map").glob("*.xml")}
    assert len(files) == 6 and not (tmp_path / "map" / "_parts").exists()
    mark = f"{{{sitemaps.NAMESPACE}}}"
    assert [x.text for x in files["sitemap-index.xml"].iter(f"{mark}loc")] == [f"https://x.org/sitemap/{k}.xml" for k in range(5)]
    assert {x.text for k in range(5) for x in files[f"{k}.xml"].iter(f"{mark}loc")} == {f"https://x.org/?a=<&>'\"é{k}" for k in range(103)}
    sitemaps.write_sitemap(urls(2), path)  # fewer chunks: the others go
    assert sorted(p.name for p in (tmp_path / "map").glob("*.xml")) == ["0.xml", "1.xml", "sitemap-index.xml"]


def test_a_failed_sitemap_leaves_the_old_one(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/map"
    good = spark.createDataFrame([(0, "https://x.org/a")], "chunk int, loc string")
    sitemaps.write_sitemap(good, path)
    before = {p.name: p.read_bytes() for p in (tmp_path / "map").iterdir() if p.suffix == ".xml"}
    bad = good.withColumn("loc", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        sitemaps.write_sitemap(bad, path)
    assert {p.name: p.read_bytes() for p in (tmp_path / "map").iterdir() if p.suffix == ".xml"} == before and not (tmp_path / "map" / "_parts").exists()


def test_two_runs_of_a_task_make_one_file(tmp_path):
    from pyspark.sql import Row

    writer = sitemaps.Writer({"path": f"file://{tmp_path}/map"}, True)
    rows = [Row(chunk=0, loc="a"), Row(chunk=0, loc="b"), Row(chunk=1, loc="c")]
    writer.write(iter(rows))
    writer.commit([writer.write(iter(rows)), None])
    assert sorted(p.name for p in (tmp_path / "map").iterdir()) == ["0.xml", "1.xml", "sitemap-index.xml"]
    with pytest.raises(ValueError, match="several tasks"):
        writer.commit([writer.write(iter(rows[:1])), writer.write(iter(rows[1:2]))])
