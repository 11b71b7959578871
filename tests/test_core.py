"""Operators against worked examples, definitions written out slowly, and reordered inputs."""

import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestry.functions import scalars, stats
from attestry.operators import agreement, completeness, constraints, dedup, frames, metrics, partition, querygen, responses, validate
from attestry.operators.consolidate import consolidate
from attestry.plans import exchange, generate, iaa, score
from attestry.paths import Workspace
from attestry.schemas import LABEL_COLUMNS, SNAPSHOT, export_schema
from attestry.settings import INHERIT, UNSET, AnnotationSettings, EvalScoreSettings, SettingsError, deep_merge, environment, resolve, safe_segment
from attestry.sources import readers, writers

N = None
PANEL = [
    [0, 1, 0, 0, 0, 0, 0, 0, 1, 0, N, N],
    [0, 1, 1, 0, 0, 1, 0, 0, 0, 0, N, N],
    [N, 1, 0, 0, 0, 0, 0, 0, 1, 0, 0, 0],
    [0, 1, 0, 0, 0, 1, 0, 0, 0, 0, 0, N],
]
PAIR = [[1, 0, 1, 0, 1, 0], [1, 0, 0, 0, 1, 0]]
RET = "record_uuid string, chunk_id string, chunk_rank int, query string, chunk string, topically_relevant int, evidence_sufficient int, misleading int, ord long"


def ret(spark, rows):
    return spark.createDataFrame([(u, c, k, "q", "x", t, e, m, i) for i, (u, c, k, t, e, m) in enumerate(rows)], RET)


def long(spark, matrix):
    rows = [(f"i{j:02d}", f"a{i}", "y", v) for i, row in enumerate(matrix) for j, v in enumerate(row) if v is not None]
    return spark.createDataFrame(rows, "item string, annotator_id string, label string, value int")


def counts(matrix):
    cells = [[v for v in c if v is not None] for c in zip(*matrix)]
    return np.array([len(c) for c in cells]), np.array([sum(c) for c in cells])


def test_wilson_examples(spark):
    assert stats.wilson_interval(8, 10) == pytest.approx((0.4901, 0.9433), abs=1e-3)
    assert stats.wilson_interval(10, 10) == pytest.approx((0.7224, 1.0), abs=1e-3)
    assert all(math.isnan(x) for x in stats.wilson_interval(0, 0))
    with pytest.raises(ValueError):
        stats.wilson_interval(3, 2)
    low, high = stats.wilson(F.col("k"), F.col("n"))
    rows = spark.createDataFrame([(8, 10), (0, 0), (0, 5)], "k int, n int").select(low.alias("a"), high.alias("b")).collect()
    assert (rows[0].a, rows[0].b) == pytest.approx(stats.wilson_interval(8, 10))
    assert rows[1].a is None and rows[2].a == 0


def test_per_query_metrics_with_rank_gaps(spark):
    df = ret(spark, [("r1", "a", 2, 1, 1, 0), ("r1", "b", 7, 1, 0, 0), ("r1", "c", 9, 0, 0, 0), ("r2", "a", 1, 0, 0, 1), ("r2", "b", 2, 1, 0, 1), ("r3", "a", 4, 0, 0, 0)])
    rows = {r.record_uuid: r for r in metrics.retrieval_per_query(df).collect()}
    assert [rows[k].topical_precision for k in ("r1", "r2", "r3")] == pytest.approx([2 / 3, 0.5, 0])
    assert [rows[k].reciprocal_rank for k in ("r1", "r2", "r3")] == pytest.approx([1, 0.5, 0])
    assert [rows[k].ndcg for k in ("r1", "r2", "r3")] == pytest.approx([1, 1 / math.log2(3), 0])
    assert [rows[k].misleading_rate for k in ("r1", "r2")] == pytest.approx([0, 1])
    assert metrics.retrieval_corpus(metrics.retrieval_per_query(df)).first().top_k == 9


def test_ndcg_of_grades(spark):
    df = ret(spark, [("r", "a", 1, 1, 0, 0), ("r", "b", 2, 1, 1, 0), ("r", "c", 3, 0, 0, 0)])
    assert metrics.retrieval_per_query(df).first().ndcg == pytest.approx(0.796708, abs=1e-5)
    scalars.register_sql(spark)
    assert spark.sql("SELECT ndcg(array(1, 2, 0)) x").first().x == pytest.approx(0.796708, abs=1e-5)


def slow_consolidation(rows, n_labels=3):
    out = []
    for key, group in itertools.groupby(sorted(rows, key=lambda r: (r[0], r[-1])), key=lambda r: r[0]):
        group = list(group)
        n, strict = len(group), {}
        for j in range(1, 1 + n_labels):
            pos = sum(r[j] for r in group)
            if pos * 2 != n:
                strict[j] = int(pos * 2 > n)
        pick = next((r for r in group if all(r[j] == v for j, v in strict.items())), group[0])
        out.append((key, *[strict.get(j, pick[j]) for j in range(1, 1 + n_labels)], pick[-1], group[0][-1]))
    return out


def test_consolidation_is_the_definition_in_any_order(spark):
    rng = random.Random(3)
    raw = [(f"u{rng.randint(0, 60)}", rng.randint(0, 1), rng.randint(0, 1), rng.randint(0, 1), i) for i in range(260)]
    want = slow_consolidation(raw)
    for seed in (0, 1):
        shuffled = raw[:]
        random.Random(seed).shuffle(shuffled)
        df = spark.createDataFrame([(u, "c", i + 1, "q", str(i), a, b, c, i) for u, a, b, c, i in shuffled], RET).repartition(5)
        got = sorted((r.record_uuid, r.topically_relevant, r.evidence_sufficient, r.misleading, int(r.chunk), r.ord) for r in consolidate(df, "retrieval").collect())
        assert got == sorted(want)


def test_consolidation_keeps_booleans_and_frames_without_keys(spark):
    df = spark.createDataFrame([("r", True, False, True, False, False, 0), ("r", True, True, True, False, False, 1)], "record_uuid string, " + ", ".join(f"{x} boolean" for x in LABEL_COLUMNS["grounding"]) + ", ord long")
    r = consolidate(df, "grounding").collect()
    assert len(r) == 1 and r[0].support_present is True and r[0].unsupported_claim_present is False
    assert consolidate(df.drop("record_uuid"), "grounding").count() == 2
    nulls = spark.createDataFrame([(None, True, False, True, False, False, 0), (None, True, False, True, False, False, 1)], df.schema)
    assert consolidate(nulls, "grounding").count() == 1


def slow_alpha(matrix):
    cells = [c for c in ([v for v in col if v is not None] for col in zip(*matrix)) if len(c) > 1]
    n = sum(map(len, cells))
    if not n:
        return None
    observed = sum(sum(a != b for a, b in itertools.permutations(c, 2)) / (len(c) - 1) for c in cells) / n
    values = [v for c in cells for v in c]
    expected = sum(a != b for a, b in itertools.permutations(values, 2)) / (n * (n - 1))
    return 1.0 if expected == 0 else 1 - observed / expected


def test_krippendorff(spark):
    rng = random.Random(5)
    for matrix in [PANEL, PAIR, [[1, 1], [1, 1]], [[1, N], [N, 0]], *[[[rng.choice((0, 1, N)) for _ in range(7)] for _ in range(4)] for _ in range(6)]]:
        want = slow_alpha(matrix)
        df = long(spark, matrix)
        for out in (agreement.krippendorff(agreement.item_counts(df)), agreement.krippendorff_nominal(df)):
            got = out.first()
            assert got is None and want is None or (got.alpha is None) == (want is None)
            if want is not None:
                assert got.alpha == pytest.approx(want)
        assert iaa.alpha_of(*counts(matrix)) == pytest.approx(want, nan_ok=True) if want is not None else math.isnan(iaa.alpha_of(*counts(matrix)))
    assert slow_alpha(PANEL) == pytest.approx(0.4907, abs=1e-3)


def test_bootstrap_alpha_examples():
    assert iaa.alpha_interval(*counts(PANEL), 100, 0.05, 42) == pytest.approx((-7.827072323607348e-16, 0.8571428571428571), abs=1e-9)
    assert iaa.alpha_interval(*counts(PAIR), 200, 0.05, 42) == pytest.approx((-0.1, 1.0), abs=1e-9)
    assert all(math.isnan(x) for x in iaa.alpha_interval(np.zeros(0), np.zeros(0), 10))


def test_agreement_bootstrap_at_scale(spark):
    rng = np.random.default_rng(2)
    m, k = np.full(3000, 3), rng.integers(0, 4, 3000)
    pairs = spark.createDataFrame([(f"i{i}", int(a), int(b)) for i, (a, b) in enumerate(zip(m, k))] + [("one", 1, 1)], "item string, m long, k long")
    want = iaa.alpha_interval(m, k, 300, 0.05, 1)
    assert iaa.scale_interval(pairs, 300, 0.05, 1) == pytest.approx(want, abs=0.02)
    assert all(math.isnan(x) for x in iaa.scale_interval(pairs.limit(0), 10, 0.05, 1))


def test_kappa_and_agreement(spark):
    df = long(spark, PAIR)
    k = agreement.cohen_kappa(df).first()
    po, pe = 5 / 6, (3 * 2 + 3 * 4) / 36
    assert (k.annotator_a, k.annotator_b, k.n_shared_items) == ("a0", "a1", 6) and k.kappa == pytest.approx((po - pe) / (1 - pe))
    assert agreement.percentage_agreement(agreement.item_counts(df)).first().pct_agreement == pytest.approx(5 / 6)
    assert agreement.cohen_kappa(long(spark, [[1, 1], [1, 1]])).count() == 0
    assert agreement.percentage_agreement(agreement.item_counts(long(spark, [[1, N], [N, 1]]))).first().pct_agreement is None


def test_bootstrap_modes_agree_roughly(spark):
    units = spark.range(4000).select(F.col("id").alias("ord"), (F.col("id") % 3 == 0).cast("double").alias("x"))
    exact = score.bootstrap_means(units, ["x"], 300, 0.05, 1).first()
    scale = score.bootstrap_means(units, ["x"], 300, 0.05, 1, mode="scale").first()
    with pytest.raises(ValueError):
        score.bootstrap_means(units, ["x"], exact_units=10)
    with pytest.raises(ValueError):
        score.bootstrap_means(units, ["x"], mode="other")
    assert (exact.mode, scale.mode) == ("exact", "scale")
    assert exact.ci_lower == pytest.approx(scale.ci_lower, abs=0.006) and exact.ci_upper == pytest.approx(scale.ci_upper, abs=0.006)
    assert score.bootstrap_means(units.limit(0), ["x"]).count() == 0


def test_score_report(spark, tmp_path):
    rows = [("r1", "c1", 1, 1, 1, 0), ("r1", "c2", 2, 1, 0, 0), ("r2", "c3", 1, 0, 0, 1), ("r2", "c3", 1, 0, 0, 1)]
    report = score.score_frame(ret(spark, rows), "retrieval", n_resamples=20, seed=1)
    assert (report.n_examples, report.top_k) == (2, 2)
    assert report.metrics["topical_precision_at_k"].point == pytest.approx(0.5)
    assert report.metrics["sufficiency_hit_at_k"].method == "wilson"
    path = str(tmp_path / "in.csv")
    writers.write_csv(ret(spark, rows).drop("ord"), path)
    again = score.score(spark, "retrieval", path=path, n_resamples=20, seed=1)
    assert again.metrics == report.metrics and "topical_precision_at_k" in score.table(again)
    json.dumps(again.to_dict())
    with pytest.raises(ValueError):
        score.score(spark, "retrieval", path=path, export=path)
    with pytest.raises(validate.ContractError):
        score.score_frame(ret(spark, [("r1", "c1", 1, 1, 1, 0), ("r1", "c2", 1, 1, 0, 0)]), "retrieval")


def test_report_invariants():
    good = score.Metric(0.5, 0.4, 0.6, "wilson", 3)
    for bad in ((1.5, 0, 1, "wilson", 3), (0.5, 0.6, 0.4, "wilson", 3), (0.5, 0, 1, "other", 3), (0.5, 0, 1, "wilson", 0)):
        with pytest.raises(ValueError):
            score.Metric(*bad)
    for change in ({"n_examples": 0}, {"ci_level": 1.0}, {"top_k": None}, {"metrics": {"m": None}}):
        with pytest.raises(ValueError):
            score.ScoreReport(**({"task": "retrieval", "source": {}, "n_examples": 1, "ci_level": 0.9, "metrics": {"m": good}, "top_k": 2} | change))


def test_score_finds_exports(spark, tmp_path):
    ws = Workspace(tmp_path)
    rows = [("r1", "c1", 1, 1, 1, 0), ("r1", "c2", 2, 1, 0, 0)]
    with pytest.raises(FileNotFoundError):
        score.score(spark, "retrieval", workspace=ws)
    for i, name in enumerate(("e1", "e2", "e3")):
        if name != "e3":  # a sidecar alone isn't an export of the task
            writers.write_csv(ret(spark, rows[: i + 1]).drop("ord"), str(ws.export(name) / "retrieval.csv"))
        writers.atomic_json(ws.export(name) / "meta.json", {"created_at": f"2026-0{i + 1}-01", "tasks": ["retrieval"]})
    one = score.score(spark, "retrieval", export="e1", workspace=ws, n_resamples=5, score_id="s1")
    assert one.source == {"kind": "annotation_export", "ref": "e1", "resolved_path": "annotation/exports/e1/retrieval.csv"} and one.top_k == 1
    assert json.loads((ws.scores("s1") / "retrieval_scores.json").read_text())["n_examples"] == 1
    assert score.score(spark, "retrieval", workspace=ws, n_resamples=5).source["ref"] == "e2"
    for name in ("e3", "e9"):
        with pytest.raises(FileNotFoundError):
            score.score(spark, "retrieval", export=name, workspace=ws)


def test_rows_are_in_file_order(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    n = {"a": 3, "b": 400, "c": 40}
    for name, k in n.items():
        (folder / f"{name}.csv").write_text("record_uuid,v\n" + "".join(f"{name},{i}\n" for i in range(k)))
        (folder / f"{name}.jsonl").write_text("".join(json.dumps({"query": f"{name} {i}"}) + "\r\n\n" for i in range(k)))
    got = readers.read_eval_csv(spark, str(folder / "*.csv")).orderBy("ord").collect()
    want = [(name, str(i)) for name in "abc" for i in range(n[name])]
    assert [(r.record_uuid, r.v) for r in got] == want and [r.ord for r in got] == list(range(len(want)))
    lines = readers.read_jsonl(spark, str(folder / "*.jsonl")).orderBy("ord").collect()
    assert [tuple(r.query.split()) for r in lines] == want
    whole = str(tmp_path / "split.csv")
    (tmp_path / "split.csv").write_text("record_uuid,v\n" + "".join(f"r{i},{i}\n" for i in range(5000)))
    assert [int(r.v) for r in readers.read_eval_csv(spark, whole).orderBy("ord").collect()] == list(range(5000))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")  # splits of a file
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        (folder / "z.jsonl").write_text("".join(json.dumps({"query": f"z {i}"}) + "\n" for i in range(900)))
        lines = readers.read_jsonl(spark, str(folder / "*.jsonl")).orderBy("ord").collect()
        assert [tuple(r.query.split()) for r in lines] == want + [("z", str(i)) for i in range(900)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_tables_are_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    one, two = (spark.createDataFrame([(str(i), v)], "record_id string, v int") for i, v in ((1, 1), (1, 2)))
    writers.upsert_records(one, path)
    writers.upsert_records(two, path)
    assert spark.read.parquet(path).first().v == 2
    (tmp_path / "t").rename(tmp_path / "t.old")  # as a crash between the two renames leaves it
    assert writers.settle(spark, path) and spark.read.parquet(path).first().v == 2 and not writers.settle(spark, str(tmp_path / "none"))


def test_conditional_fabrication_absent(spark):
    g = spark.createDataFrame([("r", "a", "c", 1, 0, 0, 0, 0, 0)], "record_uuid string, answer string, context_set string, " + ", ".join(f"{x} int" for x in LABEL_COLUMNS["grounding"]) + ", ord long")
    assert score.score_frame(g, "grounding").metrics["conditional_fabrication_rate"] is None


def test_validation_collects_everything(spark):
    df = ret(spark, [(" ", "c", 0, 2, 1, 0), ("r", None, 1, None, 0, 0)])
    with pytest.raises(validate.ContractError) as e:
        validate.validate(df, "retrieval")
    assert set(e.value.failures) == {"record_uuid: blank", "chunk_id: null", "chunk_rank: not a rank", "topically_relevant: null", "topically_relevant: not 0 or 1"}
    with pytest.raises(validate.ContractError, match="no rows"):
        validate.validate(df.limit(0), "retrieval")
    with pytest.raises(validate.ContractError, match="missing column"):
        validate.validate(df.drop("chunk"), "retrieval")
    with pytest.raises(validate.ContractError, match="not allowed"):
        validate.validate(df, "retrieval", "predict")


def test_constraints(spark):
    df = ret(spark, [("r", "a", 1, 0, 1, 1), ("r", "b", 2, 1, 1, 0)])
    rows = constraints.with_violations(df, "retrieval").orderBy("ord").collect()
    assert rows[0].constraint_details == "retrieval: evidence_sufficient=True but topically_relevant=False;retrieval: evidence_sufficient=True but misleading=True"
    assert rows[1].constraint_details == "" and not rows[1].constraint_violated
    assert {r.constraint_id: r.n for r in constraints.violation_counts(df, "retrieval").collect()} == {"evidence_requires_relevance": 1, "evidence_excludes_misleading": 1}
    with pytest.raises(ValueError):
        constraints.rules_of("retrieval", constraints.RULES + constraints.RULES[:1])


def test_panels(spark):
    rows = [("w", "d", "p", "1", 2, 1, 1, 0), ("w", "d", "p", "2", 2, 1, 0, 1), ("w", "d", "q", "1", 1, 3, 1, 0), ("w", "d", "", "1", 1, 1, 1, 0), ("w", "d", "z", "1", 0, 1, 0, 0), ("w", "d", "z", "2", 3, 1, 0, 0)]
    rec = spark.createDataFrame(rows, "workspace string, dataset string, record_uuid string, chunk_id string, n_retrieved_chunks int, min_submitted int, n_submitted long, n_discarded long")
    p = {r.record_uuid: r for r in completeness.panel_completeness(rec).collect()}
    assert set(p) == {"p", "q", "z"} and not p["p"].panel_complete and p["q"].panel_complete and p["z"].integrity_warning
    assert completeness.completeness_summary(completeness.panel_completeness(rec), rec).first().n_orphans_skipped == 1
    s = {r.record_uuid: r for r in completeness.panel_status(rec).collect()}
    assert not s["q"].overlap_satisfied and s["q"].panel_complete and s["p"].integrity_ok
    tags = rec.withColumn("tags", F.when(F.col("record_uuid") == "q", F.array(F.lit("TRUE ")))).where("record_uuid <> ''")
    actions = {(r.record_uuid, r.chunk_id): r.action for r in completeness.tag_actions(tags.withColumn("n_discarded", F.lit(0))).collect()}
    assert actions == {("p", "1"): "none", ("p", "2"): "tag", ("q", "1"): "clear", ("z", "1"): "none", ("z", "2"): "none"}


def test_scalars(spark):
    one = spark.range(1)
    r = one.select(
        scalars.strip(F.lit("  a\n")).alias("strip"), scalars.non_blank(F.lit("  ")).alias("blank"), scalars.yes_no(F.lit("no")).alias("no"), scalars.yes_no(F.lit(None).cast("string")).alias("null"),
        scalars.dataset_name(F.lit("retrieval"), F.lit(True), "x").alias("name"), scalars.dataset_name(F.lit("retrieval"), F.lit(False), "").alias("plain"), scalars.candidate_id(F.lit(7)).alias("c"), scalars.candidate_id(F.lit(12345)).alias("long"),
        scalars.merged_metadata(F.create_map(F.lit("a"), F.lit("1")), F.create_map(F.lit("b"), F.lit("2")), ["a"]).alias("m"), scalars.merged_metadata(F.create_map(F.lit("a"), F.lit("1")), F.create_map(F.lit("a"), F.lit("1")), []).alias("same"),
    ).first()
    assert (r.strip, r.blank, r.no, r.null, r.name, r.plain, r.c, r.long) == ("a", False, False, None, "retrieval_calibration_x", "retrieval_production", "c007", "c12345")
    assert r.m == {"b": "2"} and r.same is None


RECORDS = [
    {"query": " q1 ", "answer": "a1", "context_set": "s", "chunks": [{"chunk_id": "b", "doc_id": "d", "chunk_rank": 2, "text": "t"}, {"chunk_id": "a", "doc_id": "d", "chunk_rank": 1, "text": "u"}]},
    {"query": "q2", "answer": "a2", "context_set": "s", "language": "de", "chunks": [{"chunk_id": "c", "doc_id": "d", "chunk_rank": 1, "text": "v\n\"w\""}]},
    {"query": "q3", "answer": " ", "context_set": "s", "chunks": []},
]


def test_sources_agree(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps(RECORDS))
    (tmp_path / "r.jsonl").write_text("\n\n".join(json.dumps(r) for r in RECORDS) + "\n")
    spark.createDataFrame([(r["query"], r["answer"], r["context_set"], r.get("language") or "", json.dumps(r["chunks"])) for r in RECORDS], "query string, answer string, context_set string, language string, chunks string").coalesce(1).write.options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(str(tmp_path / "r_csv"))
    import pandas as pd

    want = [(r.query, r.answer, [c.chunk_id for c in r.chunks]) for r in readers.read_records(spark, RECORDS).orderBy("ord").collect()]
    for source, kind in ((str(tmp_path / "r.json"), "auto"), (str(tmp_path / "r.jsonl"), "auto"), (str(tmp_path / "r_csv"), "csv"), (pd.DataFrame(RECORDS), "auto")):
        got = readers.read_records(spark, source, kind).orderBy("ord").collect()
        assert [(r.query, r.answer, [c.chunk_id for c in r.chunks]) for r in got] == want
        assert got[1].chunks[0].text == 'v\n"w"'
    (tmp_path / "bad.jsonl").write_text('{"query": "x"}\n\n[1]\n')
    with pytest.raises(readers.SourceError, match="line 3"):
        readers.read_records(spark, str(tmp_path / "bad.jsonl"))
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(readers.SourceError):
        readers.read_records(spark, str(tmp_path / "bad.json"))
    with pytest.raises(FileNotFoundError):
        readers.read_records(spark, str(tmp_path / "none.csv"))
    with pytest.raises(TypeError):
        readers.read_records(spark, 3)


def test_typed_csv(spark, tmp_path):
    schema = export_schema("generation")
    rows = spark.createDataFrame([("u", "a", "generation", None, True, None, None, "x", "submitted", None, None, 'q "1"', "line\nbreak, NA", True, False, None, True, False, "", False, "")], schema)
    path = str(tmp_path / "g.csv")
    assert writers.write_csv(rows, path)
    again = readers.read_typed_csv(spark, path, schema).drop("ord")
    row = again.first().asDict()
    assert row["answer"] == "line\nbreak, NA" and row["query"] == 'q "1"' and row["calibration"] is True and row["helpful"] is None
    assert writers.write_csv(rows.limit(0), path) and readers.read_typed_csv(spark, path, schema).count() == 0
    assert not writers.write_csv(rows.limit(0), str(tmp_path / "none.csv"), header_when_empty=False)
    writers.write_csv(rows.withColumn("more", F.lit(1)), path)
    with pytest.raises(readers.SourceError):
        readers.read_typed_csv(spark, path, schema)


def test_assignment_is_stable_and_fills_in(spark):
    good, bad = validate.split_valid(readers.read_records(spark, RECORDS))
    assert bad.first().errors == ["answer is blank", "chunks is empty"]
    records = partition.last_by_uuid(partition.with_record_uuid(good))
    import hashlib

    first = records.where("query = 'q1'").first()
    assert first.record_uuid == hashlib.sha256("q1\0a1\0s\0a|b".encode()).hexdigest()
    one = partition.assign(partition.units(records, ["retrieval"]), None, 7, {"retrieval": 1.0}, "i1")
    both = partition.assign(partition.units(records), one, 7, {"retrieval": 0.0, "grounding": 0.0, "generation": 1.5}, "i2")
    rows = {(r.task, r.chunk_id): r for r in both.where(F.col("record_uuid") == first.record_uuid).collect()}
    assert rows["retrieval", "a"].is_calibration and rows["retrieval", "a"].import_id == "i1" and not rows["retrieval", "a"].is_new
    assert not rows["grounding", ""].is_calibration and rows["generation", ""].is_calibration and rows["generation", ""].is_new
    digest = int(hashlib.sha256(f"7\0retrieval\0{first.record_uuid}:a".encode()).hexdigest()[:8], 16)
    f = partition.assign(partition.units(records, ["retrieval"]), None, 7, {"retrieval": (digest + 1) / 2**32})
    assert f.where(F.col("chunk_id") == "a").first().is_calibration
    assert {r.task: r.n_units for r in partition.partition_summary(one, {}).collect()} == {"retrieval": 3, "grounding": 0, "generation": 0}
    assert partition.capped(one, {"retrieval": 1}, 7).where("is_calibration").count() == 1


def test_import_export_round_trip(spark, tmp_path):
    store = exchange.ParquetStore(spark, str(tmp_path / "store"))
    ws = Workspace(tmp_path / "ws")
    settings = AnnotationSettings(calibration_fraction=1.0, partition_seed=3)
    out = exchange.import_records(spark, RECORDS, store, settings, ws)
    assert (out.n_records, out.n_errors) == (2, 1) and out.counts == {"retrieval_calibration": 3, "grounding_calibration": 2, "generation_calibration": 2}
    again = exchange.import_records(spark, RECORDS, store, AnnotationSettings(calibration_fraction=0.0, partition_seed=9), ws)
    assert again.counts == out.counts
    log = spark.read.parquet(str(tmp_path / "store/records"))
    assert log.count() == 7 and log.select("record_id").distinct().count() == 7
    r = log.where("task = 'retrieval'").collect()
    data = []
    for i, x in enumerate(r):
        answers = [("u1", q, "yes" if i else "no", "submitted") for q in LABEL_COLUMNS["retrieval"]] + [("u2", "notes", "n", "discarded")]
        data.append(("ws", x.dataset, "retrieval", True, x.record_uuid, x.chunk_id, "completed", None, None, x.fields, x.metadata, None, 1, answers))
    spark.createDataFrame(data, SNAPSHOT).write.parquet(str(tmp_path / "store/snapshot"))
    meta = exchange.export_annotations(store, ws, "e1")
    assert meta["row_counts"] == {"retrieval": 3, "grounding": 0, "generation": 0} and meta["completeness_status"] == "ok"
    assert meta["completeness_summary"]["n_complete"] == 2 and meta["constraint_summary"] == {"evidence_excludes_misleading": 2}
    csv = readers.read_typed_csv(spark, str(ws.export("e1") / "retrieval.csv"), export_schema("retrieval"))
    assert {x.annotator_id for x in csv.collect()} == {"u1"} and csv.where("panel_complete").count() == 3
    assert exchange.export_annotations(store, ws, "e2", ["retrieval"], include_discarded=True)["row_counts"]["retrieval"] == 6
    assert ws.latest("annotation/exports", "grounding").name == "e1"
    status = exchange.report_status(store, tag_partial_panels=True)
    assert status["totals"]["n_complete"] == 2 and status["tags"]["n_tagged"] == 0
    levels = {(r["level"], r["task"]): r["total"] for r in status["progress"]}
    assert levels[("grand", None)] == 3 and status["progress"][0]["completed"] == 3 and "retrieval_calibration" in exchange.status_table(status["progress"])
    half = [(*x[:-1], [] if i % 2 and x[4] == data[0][4] else x[-1]) for i, x in enumerate(data)]
    other = exchange.ParquetStore(spark, str(tmp_path / "half"))
    spark.createDataFrame(half, SNAPSHOT).write.parquet(str(tmp_path / "half/snapshot"))
    n = exchange.report_status(other, tag_partial_panels=True)["tags"]["n_tagged"]
    assert n == sum(not x[-1] for x in half) == other.snapshot().where("array_contains(tags, 'true')").count()
    assert exchange.report_status(other, tag_partial_panels=True)["tags"] == {"n_tagged": 0, "n_cleared": 0, "n_already_tagged": n}
    key = ("ws", half[0][1], half[0][4], half[0][5])
    change = spark.createDataFrame([(*key, {"note": "n"})], "workspace string, dataset string, record_uuid string, chunk_id string, updates map<string,string>")
    before = {(x.record_uuid, x.chunk_id): dict(x.metadata) for x in other.snapshot().collect()}
    other.update_metadata(change, remove=("chunk_rank",))
    after = {(x.record_uuid, x.chunk_id): dict(x.metadata) for x in other.snapshot().collect()}
    want = {k: v for k, v in before[key[2:]].items() if k != "chunk_rank"} | {"note": "n"}
    assert after == before | {key[2:]: want} and want != before[key[2:]]
    lacking = [(*x[:-1], [a for a in x[-1] if a[1] != "misleading"]) for x in data]
    spark.createDataFrame(lacking, SNAPSHOT).write.parquet(str(tmp_path / "lack/snapshot"))
    with pytest.raises(ValueError, match="misleading"):
        exchange.export_annotations(exchange.ParquetStore(spark, str(tmp_path / "lack")), ws, "e3", ["retrieval"])
    assert not ws.export("e3").exists()
    report = iaa.agreement_report({"retrieval": csv}, n_resamples=10, seed=1)
    assert report["tasks"][0]["labels"][0]["alpha"] is None and report["tasks"][0]["pairwise_kappa"] == []


def test_response_flattening(spark):
    answers = [("u", "topically_relevant", "yes", "submitted"), ("u", "topically_relevant", "no", "draft"), ("v", "misleading", "yes", "draft")]
    s = spark.createDataFrame([("w", "retrieval_production", "retrieval", False, None, "c", "pending", None, None, {"query": "q", "chunk": "x"}, {}, None, 1, answers)], SNAPSHOT)
    rows = responses.annotation_rows(s, spark.createDataFrame([("u", "Ann")], "id string, username string"), "retrieval").collect()
    assert len(rows) == 1 and rows[0].annotator_id == "Ann" and rows[0].topically_relevant is False and rows[0].misleading is None
    assert rows[0].record_uuid == "" and rows[0].n_retrieved_chunks == -1 and rows[0].chunk_rank == 0 and rows[0].notes == ""
    assert responses.missing_labels(responses.annotation_rows(s, None, "retrieval"), "retrieval").first().missing == ["evidence_sufficient", "misleading"]


def slow_greedy(n, pairs):
    gone = set()
    for i in range(n):
        if i not in gone:
            gone |= {j for a, j in pairs if a == i}
    return gone


def test_greedy_selection(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    chain = [(0, 2), (1, 3), (2, 3)]
    rng = random.Random(1)
    for n, pairs in ((4, chain), (25, [(a, b) for a, b in itertools.combinations(range(25), 2) if rng.random() < 0.1]), (3, [])):
        df = spark.createDataFrame(pairs, "i long, j long")
        assert {r.id for r in dedup.greedy_removed(df).collect()} == slow_greedy(n, pairs)


def test_similar_pairs(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if u[i] @ u[j] >= 0.7}
    for rows in (7, 1000):
        assert {(r.i, r.j) for r in dedup.similar_pairs(df, 0.7, rows).collect()} == want
    assert dedup.similar_pairs(df.limit(0), 0.7).count() == 0


class Model:
    def plan(self, spec, ids, memory):
        names = ["x", "y", "x", "z"]
        return [{"candidate_id": c, "domain": names[i % 4], "user_scenario": "s", "information_need": "n"} for i, c in enumerate(ids)] + [{"candidate_id": "c999", "domain": "w"}, {"candidate_id": ids[0], "domain": "late"}]

    def realize(self, blueprints):
        return [{"candidate_id": b["candidate_id"], "query": f"q {b['domain']}"} for b in reversed(blueprints)]

    def update(self, memory, blueprints):
        return {"n": (memory or {}).get("n", 0) + len(blueprints)}


def test_query_generation(spark, tmp_path):
    from attestry.settings import QueryGenSettings

    out = generate.gen_queries(spark, {"domains": ["a", "b"]}, Model(), Model(), Model(), None, QueryGenSettings(n_queries=4, batch_size=3), "r", Workspace(tmp_path))
    rows = [(r.query_id, r.query, r.domain) for r in out.orderBy("query_id").collect()]
    assert rows == [("r_q1", "q x", "x"), ("r_q2", "q y", "y")]
    assert json.loads((tmp_path / "querygen/planning_summary.json").read_text())["summary"]["n"] == 8
    with pytest.raises(KeyError):
        querygen.assemble(spark.createDataFrame([("k", "q", 1)], "candidate_id string, query string, ord long"), spark.createDataFrame([], "candidate_id string, ord long"), "r")
    assert generate.canonical_choices(["a", "b"])[0]["weight"] == 0.5
    for bad in ([], None, ["a", {"value": "b", "weight": 1}], [{"value": "a", "weight": 0.5}]):
        with pytest.raises(ValueError):
            generate.canonical_choices(bad)


def test_failing_models_name_their_stage(spark, tmp_path):
    class Failing(Model):
        def realize(self, blueprints):
            raise OSError("down")

    with pytest.raises(generate.StageError, match="realization failed: down") as e:
        generate.gen_queries(spark, {"domains": "x"}, Model(), Failing(), workspace=Workspace(tmp_path))
    assert e.value.stage == "realization" and isinstance(e.value.__cause__, OSError)


def test_classifier_frames(spark):
    df = ret(spark, [("r", "a", 1, 1, 0, 0)])
    there = frames.to_classifier(df, "retrieval")
    assert {"text", "text_pair", "split_group", "label_misleading"} <= set(there.columns)
    assert set(frames.from_classifier(there, "retrieval").columns) == set(df.columns)
    with pytest.raises(ValueError):
        frames.to_classifier(df.withColumn("text", F.lit(1)), "retrieval")
    with pytest.raises(ValueError):
        generate.train_evaluator(df, "retrieval", None, text=1)


class Trainer:
    def train(self, frame, options):
        self.seen = frame.count(), options
        return "run7"

    def predict(self, frame, model):
        return frame.withColumn("model", F.lit(model))


def test_training_runs_are_found(spark, tmp_path):
    from attestry.settings import EvalTrainSettings, UserSpec, load_users

    ws, t = Workspace(tmp_path), Trainer()
    df = ret(spark, [("r", "a", 1, 1, 0, 0)])
    writers.write_csv(df.drop("ord"), str(ws.export("e1") / "retrieval.csv"))
    writers.atomic_json(ws.export("e1") / "meta.json", {"created_at": "2026", "tasks": ["retrieval"]})
    assert generate.train_evaluator(None, "retrieval", t, workspace=ws, settings=EvalTrainSettings(checkpoint="c"), epochs=2) == "run7"
    assert t.seen == (1, {"target_name": "Retrieval evaluation", "scale_learning_rate": True, "sequence_length": 1024, "checkpoint": "c", "epochs": 2})
    assert json.loads((ws.training("run7") / "meta.json").read_text())["annotation_export_id"] == "e1"
    plain = df.select("query", "chunk", "record_uuid", "chunk_id", "chunk_rank")
    assert generate.predict_labels(plain, "retrieval", t, workspace=ws).first().model == "run7"
    for task, run in (("grounding", None), ("retrieval", "run8")):
        with pytest.raises(FileNotFoundError):
            ws.evaluator(task, run)
    with pytest.raises(ValueError):
        ws.evaluator("grounding", "run7")
    (tmp_path / "u.json").write_text('[{"username": "a", "role": "annotator"}]')
    assert load_users(tmp_path / "u.json") == [UserSpec("a", "annotator")] and load_users(None) is None
    (tmp_path / "u.json").write_text('[{"username": "a", "role": "king"}]')
    with pytest.raises(SettingsError):
        load_users(tmp_path / "u.json")


def test_prompt_variables():
    spec = {"domains": generate.canonical_choices(["a", "b"]), "roles": None}
    out = generate.planning_variables(spec, ["c001", "c002"], {"notes": "x\n y", "gaps": "z"})
    assert out == {"domains": "a (weight=0.5), b (weight=0.5)", "roles": "Not specified", "n_queries": 2, "candidate_ids": "c001, c002", "memory": "- gaps: z\n- notes: x  y\n"}
    with pytest.raises(ValueError):
        generate.planning_variables(spec, [])


def test_error_log(tmp_path):
    import logging

    from attestry.errorlog import error_log

    with error_log(tmp_path) as path:
        logging.getLogger("attestry.x").warning("no")
    assert not path.exists()
    with pytest.raises(KeyError), error_log(tmp_path):
        logging.getLogger("attestry.x").error("yes")
        raise KeyError("k")
    assert "yes" in path.read_text() and "KeyError" in path.read_text()


def test_panel_stream(spark, tmp_path):
    from attestry.streaming.panels import panel_stream

    rows = [("w", "r1", "a", "u1", "submitted", 2), ("w", "r1", "a", "u2", "submitted", 2), ("w", "r1", "b", "u1", "discarded", 2), ("w", "r2", "a", "u1", "submitted", 1), ("w", "", "a", "u1", "submitted", 1)]
    kinds = "workspace string, record_uuid string, chunk_id string, user_id string, status string, n_retrieved_chunks int"
    spark.createDataFrame(rows, kinds).withColumn("created_at", F.lit("2026-01-01 10:00:00").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kinds + ", created_at timestamp").parquet(str(tmp_path / "in"))
    q = panel_stream(stream).writeStream.format("memory").queryName("panels").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.record_uuid: (r.k, r.n_seen, r.n_submitted_chunks, r.n_discarded_chunks, r.n_annotated_chunks, r.panel_complete) for r in spark.table("panels").collect()}
    assert got == {"r1": (2, 2, 1, 1, 2, False), "r2": (1, 1, 1, 0, 1, True)}


def test_cap_keeps_the_smallest_digests(spark):
    rows = [(t, f"r{i}", "", i % 5 != 0, i % 3 != 0) for t in ("grounding", "generation") for i in range(300)]
    df = spark.createDataFrame(rows, "task string, record_uuid string, chunk_id string, is_calibration boolean, is_new boolean")
    out = partition.capped(df, {"grounding": 37}, 5)
    digest = {(r.task, r.record_uuid): r.d for r in df.select("task", "record_uuid", scalars.uniform_digest(5, F.col("task"), F.col("record_uuid")).alias("d")).collect()}
    new = sorted((digest[t, u], u) for t, u, _, cal, fresh in rows if t == "grounding" and cal and fresh)
    gone = {u for _, u in new[37:]}
    got = {(r.task, r.record_uuid): r.is_calibration for r in out.collect()}
    assert got == {(t, u): cal and not (t == "grounding" and fresh and u in gone) for t, u, _, cal, fresh in rows} and out.columns == df.columns


def test_settings():
    assert deep_merge({"a": {"b": 1, "c": 2}}, {"a": {"b": UNSET, "c": 3}}) == {"a": {"b": 1, "c": 3}}
    assert environment("P", {"P_A__B": "1", "Q": "2"}) == {"a": {"b": "1"}}
    s = resolve(EvalScoreSettings, {"seed": 1, "ci": 0.8}, {"seed": 3}, {"ATTESTRY_N_RESAMPLES": "7", "ATTESTRY_SEED": "2"})
    assert (s.seed, s.ci, s.n_resamples) == (3, 0.8, 7)
    with pytest.raises(SettingsError):
        resolve(EvalScoreSettings, {"what": 1}, env={})
    with pytest.raises(TypeError):
        bool(INHERIT)
    a = AnnotationSettings(workspaces={"w": {"calibration_fraction": 0.4, "tasks": {"retrieval": {"calibration_fraction": 0.2}, "grounding": {}}}})
    assert a.fractions() == {"retrieval": 0.2, "grounding": 0.4} and a.workspace_of("grounding") == "w"
    with pytest.raises(SettingsError):
        AnnotationSettings(workspaces={"a": {"tasks": {"retrieval": {}}}, "b": {"tasks": {"retrieval": {}}}})
    with pytest.raises(SettingsError):
        AnnotationSettings(constraint_severity={})
    for bad in ("../x", " x", "a/b", ""):
        with pytest.raises(SettingsError):
            safe_segment(bad)


def test_cli_parsers():
    from attestry import cli

    assert cli.parse_value('["a"]') == ["a"] and cli.parse_value("[1]") == "[1]" and cli.parse_value("x") == "x"
    assert cli.parse_time("2026-05-01").startswith("2026-05-01 00:00:00")
    assert cli.parser().parse_args(["eval", "score", "retrieval", "--path", "x"]).path == "x"
    args = cli.parser().parse_args(["querygen", "gen-queries", "--domains", '["a", "b"]', "--planner", "json:JSONDecoder", "--realizer", "json:loads"])
    assert args.domains == ["a", "b"] and isinstance(args.planner, json.JSONDecoder) and args.realizer is json.loads
    assert cli.parser().parse_args(["eval", "train-evaluator", "retrieval", "--classifier", "json:loads"]).export is None
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["eval", "train-evaluator", "retrieval", "--classifier", "json"])


def test_cli_makes_queries(spark, tmp_path, capsys, monkeypatch):
    from attestry import cli

    monkeypatch.setitem(__import__("sys").modules, "tests_models_here", __import__("types").SimpleNamespace(Model=Model))
    assert cli.main(["--workspace", str(tmp_path), "querygen", "gen-queries", "--domains", "x", "--planner", "tests_models_here:Model", "--realizer", "tests_models_here:Model", "--n-queries", "3", "--run-id", "q1"]) == 0
    assert json.loads(capsys.readouterr().out)["run_id"] == "q1" and (tmp_path / "querygen" / "runs" / "q1" / "queries.csv").exists()


def test_streaming_assignment(spark, tmp_path):
    from attestry.schemas import IMPORT_RECORD
    from attestry.streaming.panels import assign_stream

    src, dst = str(tmp_path / "src"), str(tmp_path / "manifest")
    readers.read_records(spark, RECORDS).drop("ord").write.parquet(src)
    for n in (1, 2):
        q = assign_stream(spark.readStream.schema(IMPORT_RECORD).parquet(src), dst, str(tmp_path / f"ck{n}"), 1, {"retrieval": 0.5, "grounding": 0.5, "generation": 0.5})
        q.awaitTermination(120)
        assert spark.read.parquet(dst).count() == 7


def test_plans_prune_and_share_exchanges(spark):
    from attestry import fixtures as fx

    df = metrics.retrieval_per_query(consolidate(fx.retrieval_labels(spark, "/root/testdata/sf0.001").repartition("record_uuid"), "retrieval"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and plan.count("Exchange hashpartitioning(record_uuid") == 1
