"""Registered queries of evaluation: the assembled report, cascades with a judge, hypotheses, dataset checks, check forms, artifacts and sorted files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators import assembly, dataset, detectors, hypotheses, review, rules, training
from tracewright.operators import steps as step_ops
from tracewright.plans import projection as at
from tracewright.plans.catalog import _LONG, _RESULTS, _r, _results, f_features, query
from tracewright.plans.sql import auroc_sql, over
from tracewright.sources import artifacts
from tracewright.sources import traces as trace_source
from tracewright.sources.folders import pinned, scratch_path
from tracewright.sources.packs import Check


# The report

_REPORT = over("predictions", f"""
, g AS (SELECT detector, 'all' AS cut, '' AS key, * EXCLUDE (detector) FROM predictions
  UNION ALL SELECT detector, 'split', split, * EXCLUDE (detector) FROM predictions UNION ALL SELECT detector, 'domain', domain, * EXCLUDE (detector) FROM predictions
  UNION ALL SELECT detector, 'kind', kind, * EXCLUDE (detector) FROM predictions UNION ALL SELECT detector, 'evidence', evidence, * EXCLUDE (detector) FROM predictions),
h AS (SELECT *, detector || '|' || cut || '|' || key AS id FROM g),
a AS ({auroc_sql("h", "id", "p")}),
e AS (SELECT id, sum(gap) / sum(n) AS ece FROM (SELECT id, count(*) AS n, abs(sum(p) - sum(label)) AS gap FROM (SELECT *, CASE {' '.join(f'WHEN p < {x!r}::DOUBLE THEN {k}' for k, x in enumerate((0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9)))} ELSE 9 END AS bin FROM h) GROUP BY id, bin) GROUP BY id)
SELECT detector, cut, key, count(*) AS n, count(*) FILTER (label = 0) AS n_failure, count(*) FILTER (label = 0 AND verdict = 'false_success') AS caught, count(*) FILTER (label = 0 AND verdict = 'verified') AS missed,
  count(*) FILTER (label = 1 AND verdict = 'false_success') AS false_alarms, count(*) FILTER (verdict = 'unverifiable') AS sent_to_review, count(*) FILTER (abstain) AS abstained,
  round(count(*) FILTER (verdict <> 'unverifiable') / count(*), 6) AS coverage,
  round(coalesce(count(*) FILTER ((label = 1 AND verdict = 'verified') OR (label = 0 AND verdict = 'false_success')) / nullif(count(*) FILTER (verdict <> 'unverifiable'), 0), 0), 6) AS accuracy_on_decided,
  round(avg((p - label) ** 2) + 1e-12::DOUBLE, 6) AS brier, round(any_value(e.ece) + 1e-12::DOUBLE, 6) AS ece, round(any_value(a.auroc) + 1e-12::DOUBLE, 6) AS auroc
FROM h JOIN e USING (id) JOIN a USING (id) GROUP BY detector, cut, key""").replace("\n\n, g AS", ", g AS")  # fmt: skip


@query(_REPORT)
def o_agg_19_report(spark, d):
    """The assembled report, taken apart again into rows. Sums in another order mustn't turn a half the other way: all are a little above it."""
    flat = assembly.flat(assembly.assemble(at.predictions(spark, d)))
    return flat.select("detector", "cut", "key", *(_r(F.col(c) + (0.0 if c in ("coverage", "accuracy_on_decided") else 1e-12), c) if c in ("coverage", "accuracy_on_decided", "brier", "ece", "auroc") else F.col(c) for c in assembly.FIGURES))


# Cascades: detector a stands for the rules, b for a judge that is only asked about what they leave open.

_CODED = "CASE WHEN p < 0.3::DOUBLE THEN 0.03 WHEN p < 0.5::DOUBLE THEN 0.70 ELSE 0.97 END::DOUBLE"
_SENT = over("predictions", f"""
, a AS (SELECT *, {_CODED} AS q FROM predictions WHERE detector = 'a'), b AS (SELECT * FROM predictions WHERE detector = 'b' AND doc_id % 13 <> 0),
c AS (SELECT a.trace_id, NOT a.abstain AND a.q <> 0.70::DOUBLE AS settled, a.q, a.latency_ms AS ms, a.cost_usd AS usd, b.p, b.abstain, b.latency_ms, b.cost_usd, b.cached, b.trace_id IS NOT NULL AS there FROM a LEFT JOIN b USING (trace_id))
""").replace("\n\n, a AS", ", a AS")  # fmt: skip


def _cascaded(spark, d) -> DataFrame:
    p = at.predictions(spark, d)
    coded = p.where("detector = 'a'").withColumn("p", F.expr("cast(CASE WHEN p < 0.3 THEN 0.03 WHEN p < 0.5 THEN 0.70 ELSE 0.97 END AS double)"))
    judged = p.where("detector = 'b' AND doc_id % 13 != 0").select("trace_id", "p", "abstain", "latency_ms", "cost_usd", "cached")
    calibrators = detectors.calibrator_table(spark, {"rules": (0.8, -0.15), "judge": (0.5, 0.1)})
    return detectors.judged_cascade(coded.select("trace_id", "domain"), coded.select("trace_id", "p", "abstain", "latency_ms", "cost_usd"), lambda left: left.join(judged, "trace_id"), calibrators)


_PLATT = "round(1 / (1 + exp(-({a}::DOUBLE * ln(least(greatest({p}, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) / (1 - least(greatest({p}, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE))) + {b}::DOUBLE))), 6)"


@query(_SENT + f"""SELECT trace_id, round(CASE WHEN settled THEN q ELSE p END, 6) AS p, CASE WHEN settled THEN false ELSE coalesce(abstain, true) END AS abstain, CASE WHEN NOT settled AND NOT there THEN 'judge_missing' END AS abstain_reason,
  CASE WHEN settled THEN {_PLATT.format(a="0.8", b="-0.15", p="q")} WHEN there AND NOT abstain THEN {_PLATT.format(a="0.5", b="0.1", p="p")} END AS p_calibrated,
  round(ms + CASE WHEN settled THEN 0 ELSE coalesce(latency_ms, 0) END, 6) AS latency_ms, round(usd + CASE WHEN settled THEN 0 ELSE coalesce(cost_usd, 0) END, 6) AS cost_usd, CASE WHEN settled THEN false ELSE coalesce(cached, false) END AS cached,
  CASE WHEN settled THEN 'rules' ELSE 'judge' END AS decided_by, NOT settled AS sent_to_judge FROM c""")  # fmt: skip
def det_10_judged_cascade(spark, d):
    c = _cascaded(spark, d)
    return c.select("trace_id", _r(F.col("p"), "p"), "abstain", "abstain_reason", _r(F.col("p_calibrated"), "p_calibrated"), _r(F.col("latency_ms"), "latency_ms"), _r(F.col("cost_usd"), "cost_usd"), "cached", "decided_by", "sent_to_judge")


@query(_SENT + "SELECT count(*) AS n, count(*) FILTER (NOT settled) AS sent, round(count(*) FILTER (NOT settled) / count(*), 6) AS share, round(0.2::DOUBLE + count(*) FILTER (NOT settled) / count(*) * 30, 6) AS wall_s_per_1k FROM c")
def o_agg_14_judge_share(spark, d):
    return detectors.judge_share(_cascaded(spark, d), 0.2, 30.0).select("n", "sent", _r(F.col("share"), "share"), _r(F.col("wall_s_per_1k"), "wall_s_per_1k"))


# Hypotheses


def _used(spark, d) -> DataFrame:
    return at.predictions(spark, d).withColumn("p_used", F.col("p") * 0.6 + 0.2)


_ECE = "(SELECT detector, sum(gap) / sum(n) AS ece FROM (SELECT detector, count(*) AS n, abs(sum(x) - sum(label)) AS gap FROM (SELECT detector, label, {x} AS x FROM predictions WHERE split = 'test') GROUP BY detector, CASE {bins} ELSE 9 END) GROUP BY detector)"
_BINS = " ".join(f"WHEN x < {x!r}::DOUBLE THEN {k}" for k, x in enumerate((0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9)))


@query(over("predictions", f"""
, s AS (SELECT detector, avg(CASE WHEN p < 0.05::DOUBLE OR p > 0.95::DOUBLE THEN 1.0 ELSE 0.0 END) AS extremes FROM predictions WHERE split = 'test' GROUP BY 1)
SELECT detector, round(extremes, 6) AS extremes_share, round(r.ece, 6) AS ece_raw, round(u.ece, 6) AS ece_calibrated, extremes > 0.5 AND u.ece < r.ece AS ok
FROM s JOIN {_ECE.format(x="p", bins=_BINS)} r USING (detector) JOIN {_ECE.format(x="p * 0.6::DOUBLE + 0.2::DOUBLE", bins=_BINS)} u USING (detector)""").replace("\n\n, s AS", ", s AS"))  # fmt: skip
def o_agg_11_overconfident(spark, d):
    return hypotheses.overconfident(_used(spark, d)).select("detector", _r(F.col("extremes_share"), "extremes_share"), _r(F.col("ece_raw"), "ece_raw"), _r(F.col("ece_calibrated"), "ece_calibrated"), "ok")


@query(over("predictions", f"""
, a AS ({auroc_sql("(SELECT * FROM predictions WHERE detector = 'a')", "domain", "p")}), b AS ({auroc_sql("(SELECT * FROM predictions WHERE detector = 'b')", "domain", "p")})
SELECT a.domain, round(a.auroc, 6) AS left_out_auroc, round(b.auroc, 6) AS shipped_auroc, coalesce(a.auroc < b.auroc, false) AS below FROM a JOIN b USING (domain)""").replace("\n\n, a AS", ", a AS"))  # fmt: skip
def o_agg_10_domain_loss(spark, d):
    p = at.predictions(spark, d)
    out = hypotheses.domain_loss(p.where("detector = 'a'"), p.where("detector = 'b'"))
    return out.select("domain", _r(F.col("left_out_auroc"), "left_out_auroc"), _r(F.col("shipped_auroc"), "shipped_auroc"), "below")


# Dataset checks


def _domains(spark) -> DataFrame:
    return spark.createDataFrame([("en",), ("de",), ("fr",), ("it",)], "domain string")


@query(over("predictions", """
, c AS (SELECT dom.domain, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'test') AS test, count(*) FILTER (split = 'test' AND label = 1) AS genuine_test, count(*) FILTER (split = 'test' AND label = 0) AS false_test
  FROM (SELECT unnest(['en', 'de', 'fr', 'it']) AS domain) dom LEFT JOIN (SELECT * FROM predictions WHERE detector = 'a') p USING (domain) GROUP BY 1)
SELECT * FROM (SELECT domain, unnest(['train', 'test', 'genuine_test', 'false_test']) AS finding, unnest([60, 40, 24, 16])::BIGINT AS wanted, unnest([train, test, genuine_test, false_test]) AS found FROM c) WHERE wanted <> found""").replace("\n\n, c AS", ", c AS"))  # fmt: skip
def val_7_sizes(spark, d):
    return dataset.sizes(at.predictions(spark, d).where("detector = 'a'"), 60, 40, 24, _domains(spark))


@query(over("predictions", """
SELECT domain, kind, count(p.trace_id) AS found FROM (SELECT domain, unnest(['wrong_value', 'wrong_target', 'phantom_action']) AS kind FROM (SELECT unnest(['en', 'de', 'fr', 'it']) AS domain))
LEFT JOIN (SELECT * FROM predictions WHERE detector = 'a' AND split = 'test' AND label = 0) p USING (domain, kind) GROUP BY ALL HAVING count(p.trace_id) < 5"""))  # fmt: skip
def val_7_rare_kinds(spark, d):
    kinds = spark.createDataFrame([("wrong_value",), ("wrong_target",), ("phantom_action",)], "kind string")
    return dataset.rare_kinds(at.predictions(spark, d).where("detector = 'a'"), kinds, _domains(spark), 5)


@query("""
SELECT coalesce(w.name, f.name) AS name, w.sha AS wanted, f.sha AS found
FROM (SELECT doc_id::VARCHAR AS name, sha256(coalesce(text, '')) AS sha FROM documents WHERE doc_id % 11 <> 3) w
FULL JOIN (SELECT doc_id::VARCHAR AS name, sha256(CASE WHEN doc_id % 7 = 2 THEN coalesce(text, '') || '!' ELSE coalesce(text, '') END) AS sha FROM documents WHERE doc_id % 13 <> 5) f USING (name) WHERE w.sha IS DISTINCT FROM f.sha""")
def val_7_digests(spark, d):
    """A manifest of the documents against documents of which some were changed, some are gone and some are new."""
    n, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    docs = at.table(spark, d, "documents")
    manifest = docs.where(n % 11 != 3).select(n.cast("string").alias("name"), F.sha2(text, 256).alias("sha256"))
    found = docs.where(n % 13 != 5).select(n.cast("string").alias("name"), F.sha2(F.when(n % 7 == 2, F.concat(text, F.lit("!"))).otherwise(text), 256).alias("sha256"))
    return dataset.digest_differences(found, manifest)


# Checks: an output for each order, of all forms that a check can meet.

_CHECKS = {
    "last_sku": Check("items.-1.sku", "equals", "b1"),
    "first_sku": Check("items.0.sku", "equals", "a"),
    "number_key": Check("by_day.1", "equals", 7),
    "moment": Check("at", "equals", "2026-01-01T00:00:00Z", "datetime"),
    "mail": Check("mail", "equals", "user3@x.com", "email"),
    "mail_in": Check("mail", "in", ["USER1@x.com", "{subject.mail}"], "email"),
    "amount": Check("amount", "equals", 3, "number"),
    "flag": Check("flag", "equals", 1),
    "tag": Check("tags", "contains", "y1"),
    "text": Check("note", "contains", "placed"),
    "part": Check("extra", "contains", {"b": "x", "a": 1}, "string"),
    "whole": Check("", "exists", True),
    "none": Check("items.-3.sku", "exists", True),
    "null_is_found": Check("nothing", "exists", True),
    "left_out": Check("amount", "equals", "{subject.none}", "number"),
    "from_args": Check("args.k", "matches", r"^\d*5$"),
}
_CHECKS_SQL = """
WITH o AS (SELECT o_orderkey, o_orderkey % 3 AS a, o_orderkey % 4 AS b, o_orderkey % 5 AS c, o_orderkey % 2 AS e, o_orderkey % 7 AS f FROM orders),
r AS (SELECT *, unnest([
  struct_pack(name := 'last_sku', ok := a = 1), struct_pack(name := 'first_sku', ok := true), struct_pack(name := 'number_key', ok := f = 0), struct_pack(name := 'moment', ok := b <> 3),
  struct_pack(name := 'mail', ok := c = 3), struct_pack(name := 'mail_in', ok := c = 1 OR c = 2 AND e = 0), struct_pack(name := 'amount', ok := a <> 2), struct_pack(name := 'flag', ok := e = 1), struct_pack(name := 'tag', ok := e = 1),
  struct_pack(name := 'text', ok := a = 0), struct_pack(name := 'part', ok := e = 0), struct_pack(name := 'whole', ok := true), struct_pack(name := 'none', ok := false), struct_pack(name := 'null_is_found', ok := true),
  struct_pack(name := 'left_out', ok := NULL::BOOLEAN), struct_pack(name := 'from_args', ok := o_orderkey % 10 = 5)]) AS x FROM o)
SELECT o_orderkey, x.name AS name, CASE WHEN x.ok IS NULL THEN 'skipped' WHEN x.ok THEN 'pass' ELSE 'fail' END AS result FROM r
"""


@query(_CHECKS_SQL)
def chk_forms(spark, d):
    k = F.col("o_orderkey")
    pick = lambda *options: F.element_at(F.array(*(F.lit(o) for o in options)), (k % len(options) + 1).cast("int"))
    text = F.concat(
        F.lit('{"items": [{"sku": "a"}, {"sku": "b'), (k % 3).cast("string"), F.lit('"}], "by_day": {"1": '), F.when(k % 7 == 0, "7.0").otherwise("8"), F.lit('}, "at": "'),
        pick("2026-01-01T00:00:00Z", "2026-01-01T01:00:00+01:00", "2026-01-01", "soon"), F.lit('", "mail": "  User'), (k % 5).cast("string"), F.lit('@X.com ", "amount": '), pick('" 3"', "3.0000000001", '"3.1"'),
        F.lit(', "flag": '), (k % 2 == 1).cast("string"), F.lit(', "tags": ["x", "y'), (k % 2).cast("string"), F.lit('"], "note": "order was '), F.when(k % 3 == 0, "placed").otherwise("sent"),
        F.lit('", "nothing": null, "extra": {"a": "1", "b": "'), F.when(k % 2 == 0, " X ").otherwise("y"), F.lit('", "c": 0}}'),
    )
    subject = F.parse_json(F.when(k % 2 == 0, F.lit('{"mail": "user2@X.COM"}')).otherwise(F.lit('{"mail": 2}')))
    args = F.parse_json(F.concat(F.lit('{"k": '), k.cast("string"), F.lit("}")))
    rows = at.table(spark, d, "orders").select("o_orderkey", F.parse_json(text).alias("output"), subject.alias("subject"), args.alias("args"))
    each = F.array(*(F.struct(F.lit(n).alias("name"), rules.compile_check(c, F.col("subject"), F.col("args"), F.col("output")).alias("result")) for n, c in _CHECKS.items()))
    return rows.select("o_orderkey", F.explode(each).alias("x")).select("o_orderkey", "x.name", "x.result")


# Training: what is saved and loaded again, and fitted again, is the same model.


def _training_rows(spark, d) -> DataFrame:
    labels = at.traces(spark, d).where("gt_outcome != 'unknown'").select("trace_id", (F.col("gt_outcome") == "success").cast("int").alias("label"))
    return f_features(spark, d).join(labels, "trace_id")


@query(f"SELECT feature, round(avg(value), 6) AS mean, round(CASE WHEN stddev_pop(value) = 0 THEN 1.0 ELSE stddev_pop(value) END, 6) AS scale, true AS same FROM {_LONG} l JOIN ({over('traces', 'SELECT trace_id, gt_outcome FROM traces')}) t USING (trace_id) WHERE gt_outcome <> 'unknown' GROUP BY feature")
def trn_7_artifact(spark, d):
    """The classifier's artifact, loaded, by feature; same: a fit of the same rows in other partitions is within the tolerance of it."""
    rows, path = pinned(_training_rows(spark, d), "training"), scratch_path(spark, "artifact")
    made = artifacts.ArtifactFolder(spark, path)
    made.save(made.MODEL, artifacts.model_object(training.fit(rows, step_ops.FEATURES, 0.1), 0.1, {0.1: 0.0}, rows.count()))
    loaded = artifacts.ArtifactFolder(spark, path).model()
    again = training.fit(rows.repartition(3, "trace_id"), step_ops.FEATURES, 0.1)
    far = artifacts.differences(loaded, again)
    table = spark.createDataFrame([(f, float(m), float(s)) for f, m, s in zip(loaded.features, loaded.means, loaded.scales, strict=True)], "feature string, mean double, scale double")
    return table.select("feature", _r(F.col("mean"), "mean"), _r(F.col("scale"), "scale"), F.lit(not far).alias("same"))


# Sorted trace files


@query("""
WITH l AS (SELECT conv_id, turn, 'c' || lpad((conv_id * 7919 % 100003)::VARCHAR, 6, '0') || '-' || conv_id || '-' || turn || '-' || row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) AS trace_id FROM conversations)
SELECT trace_id, row_number() OVER (ORDER BY trace_id) AS place FROM l""")
def o_srt_1_sorted_traces(spark, d):
    """Traces written in order over the files; the place of each as the files are read one after the other."""
    from pyspark.sql import Window

    c = at.table(spark, d, "conversations").withColumn("n", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")))
    name = F.concat(F.lit("c"), F.lpad((F.col("conv_id") * 7919 % 100003).cast("string"), 6, "0"), F.lit("-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"), F.lit("-"), F.col("n").cast("string"))
    path = scratch_path(spark, "sorted")
    lines = trace_source.trace_lines(c.select(name.alias("trace_id"), F.parse_json(_trace_line(name)).alias("v")))
    trace_source.write_sorted(lines, path)
    read = trace_source.read_lines(spark, path)
    ahead = read.groupBy("file").agg(F.count("*").alias("n"))
    ahead = ahead.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))  # a row for each file
    return read.join(F.broadcast(ahead), "file").select(F.get_json_object("value", "$.trace_id").alias("trace_id"), (F.col("ahead") + F.col("line_no")).alias("place"))


# Reviews

_PAYLOAD = _RESULTS + """
, ev AS (SELECT trace_id, string_agg(claim_idx || ':' || outcome || ':' || coalesce(step::VARCHAR, ''), ',' ORDER BY claim_idx) AS evidence FROM outcomes GROUP BY trace_id),
sd AS (SELECT trace_id, count(*)::INTEGER AS n_steps, sha256(string_agg(i || ':' || kind || ':' || coalesce(name, '') || ':' || CASE WHEN has_error THEN CASE WHEN k % 2 = 0 THEN 'not found' ELSE '{"code":' || k || '}' END ELSE '' END, ';' ORDER BY i)) AS steps_sha256 FROM steps GROUP BY trace_id),
cd AS (SELECT trace_id, string_agg(type, ',' ORDER BY claim_idx) AS claim_types FROM claims GROUP BY trace_id)
SELECT r.trace_id, r.domain, t.final_text AS final_message, r.verdict, round(r.p_success, 6) AS p_success, n_steps, steps_sha256, coalesce(claim_types, '') AS claim_types, coalesce(evidence, '') AS evidence
FROM r JOIN traces t USING (trace_id) LEFT JOIN sd USING (trace_id) LEFT JOIN cd USING (trace_id) LEFT JOIN ev USING (trace_id)"""


@query(_PAYLOAD)
def o_prj_6_review_payload(spark, d):
    traces, steps, claims = at.traces(spark, d), at.steps(spark, d), at.claims(spark, d)
    shown = review.payload(traces, steps, claims, _results(spark, d), rules.evaluate_claims(claims, steps, traces, at.packs()))
    said = lambda a, f: F.array_join(F.transform(a, f), ",")
    digest = F.sha2(F.array_join(F.transform("steps", lambda s: F.concat_ws(":", s["i"].cast("string"), s["kind"], F.coalesce(s["name"], F.lit("")), F.coalesce(s["error"], F.lit("")))), ";"), 256)
    evidence = said("rule_evidence", lambda e: F.concat_ws(":", e["claim_idx"].cast("string"), e["outcome"], F.coalesce(e["step"].cast("string"), F.lit(""))))
    return shown.select("trace_id", "domain", "final_message", "verdict", _r(F.col("p_success"), "p_success"), F.size("steps").alias("n_steps"), digest.alias("steps_sha256"), said("claims", lambda c: c["type"]).alias("claim_types"), evidence.alias("evidence"))


@query("""
SELECT 'c' || conv_id || '-' || turn || '-' || n AS trace_id, CASE WHEN conv_id % 2 = 0 THEN 'success' ELSE 'failure' END AS outcome, 'human' AS checked_by, 'note ' || turn AS note
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) AS n FROM conversations) WHERE conv_id % 3 <> 1""")
def snk_6_reviews(spark, d):
    """Decisions on two thirds of the traces, in two batches of which one is sent twice, read back as labelled traces."""
    from pyspark.sql import Window

    c = at.table(spark, d, "conversations").withColumn("n", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")))
    name = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"), F.lit("-"), F.col("n").cast("string"))
    lines = trace_source.validate(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("line_no"), _trace_line(name).alias("value"))).lines
    decided = c.select(name.alias("trace_id"), F.when(F.col("conv_id") % 2 == 0, "verified").otherwise("false_success").alias("decision"), F.concat(F.lit("note "), F.col("turn").cast("string")).alias("note"), F.lit("unverifiable").alias("previous_verdict"), F.lit("2026-01-01T00:00:00Z").alias("reviewed_at"), (F.col("conv_id") % 3).alias("batch"))
    path = scratch_path(spark, "reviews")
    for number in (0, 2, 0):
        review.append_reviews(lines, decided.where(F.col("batch") == number).drop("batch"), path, number)
    found = trace_source.load_traces(spark, f"{path}/batch=*").traces()
    return found.select("trace_id", F.col("gt_outcome").alias("outcome"), F.col("gt_checked_by").alias("checked_by"), F.try_variant_get("gt_details", "$.note", "string").alias("note"))


def _trace_line(name):
    """The line of a small trace with a turn of a conversation as its final message."""
    task = F.struct(F.lit("crm").alias("domain"), F.lit("t").alias("id"), F.lit("do").alias("instruction"))
    step = F.struct(F.lit(0).alias("i"), F.lit("message").alias("kind"), F.lit("user").alias("role"), F.lit("2026-01-01T00:00:00Z").alias("ts"))
    return F.to_json(F.struct(F.struct(F.array().cast("array<string>").alias("claims"), F.col("text")).alias("final_claim"), F.lit(trace_source.FORMAT).alias("schema"), F.lit("test").alias("source"), F.array(step).alias("steps"), task.alias("task"), name.alias("trace_id")))
