import json
from pathlib import Path

import pytest

from veilgrid.operators import baseline, inventory
from veilgrid.plans import finding_queries as q
from veilgrid.sources import files, reports
from veilgrid.streaming import literal_stream


@pytest.fixture(scope="module")
def findings(spark):
    flows = q._applied(spark).withColumn("fingerprint", baseline.flow_fingerprint())
    accepted = spark.createDataFrame([(flows.first().fingerprint,)], "fingerprint string")
    return reports.flow_findings(baseline.mark(flows, accepted))


def document(findings, name):
    return "\n".join(r.text for r in reports.render(findings, name).orderBy("place").collect())


def test_documents(findings, tmp_path):
    assert reports.formats() == ["gitlab", "json", "markdown", "sarif", "text"]
    rows = findings.collect()
    made = {f: document(findings, f) for f in reports.formats()}
    sarif = json.loads(made["sarif"])
    assert sarif["version"] == "2.1.0" and len(sarif["runs"][0]["results"]) == len(rows)
    assert len(json.loads(made["json"])["findings"]) == len(rows)
    assert len(json.loads(made["gitlab"])["vulnerabilities"]) == sum(r.is_new for r in rows)
    assert made["markdown"].count("\n| ") == len(rows) + 1 and made["text"].count("\n") == len(rows) - 1
    reports.write_document(reports.render(findings, "sarif"), str(tmp_path / "sarif"))
    written = "".join(p.read_text() for p in sorted((tmp_path / "sarif").glob("part-*")))
    assert written.rstrip("\n") == made["sarif"]
    with pytest.raises(ValueError):
        reports.render(findings, "carrier pigeon")
    assert json.loads(document(findings.limit(0), "sarif"))["runs"][0]["results"] == []


def test_impact_report(spark):
    flows = q._applied(spark)
    kinds = q.type_inventory(spark, "/root/testdata/sf0.001") if Path("/root/testdata/sf0.001").exists() else None
    if kinds is None:
        pytest.skip("no data tables here")
    rows = reports.impact_report(inventory.recipients(flows), kinds).collect()
    assert {r.section for r in rows} == {"recipients", "data types"}
    assert sorted(r.place for r in rows if r.section == "data types") == list(range(1, kinds.count() + 1))


def test_inventory_columns(spark):
    rows = reports.flow_inventory(q._applied(spark))
    assert rows.columns == reports.CSV_COLUMNS and rows.count() == q._applied(spark).count()


def test_baseline_round_trip(spark, tmp_path):
    flows = q._applied(spark).withColumn("fingerprint", baseline.flow_fingerprint())
    made = baseline.create(flows, None)
    files.write_baseline(made, str(tmp_path / "b"))
    assert sorted(map(tuple, files.read_baseline(spark, str(tmp_path / "b")).collect()), key=str) == sorted(map(tuple, made.collect()), key=str)


def test_walk(spark, tmp_path):
    (tmp_path / "r" / "src").mkdir(parents=True)
    (tmp_path / "r" / "src" / "a.py").write_text("x = 1\n")
    (tmp_path / "r" / "logo.png").write_bytes(b"\x89\0")
    walked = files.not_ignored(files.walk(spark, str(tmp_path / "r")))
    assert [(r.path, r.size) for r in files.scannable(walked).collect()] == [("src/a.py", 6)]


def test_stream_finds_what_a_batch_finds(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"card 4532 1098 3172 6508 of {i}") for i in range(5)] + [(9, None)], "doc_id long, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = literal_stream.card_stream(literal_stream.read_texts(spark, str(tmp_path / "in"), "doc_id long, text string", 1))
    run = literal_stream.write_parquet(stream, str(tmp_path / "out"), str(tmp_path / "at"))
    run.awaitTermination(120)
    assert sorted(r.doc_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2, 3, 4]
