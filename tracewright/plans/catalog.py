"""Registered queries: each operator over the projections of the driver's tables, and its SQL for comparison."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.scores import LogisticModel, confidence, gate, platt, reservation_usd

from tracewright.operators import claims as claim_ops
from tracewright.operators import costs, dataset, detectors, hypotheses, judge, metrics, report, rules, training
from tracewright.operators import steps as step_ops
from tracewright.plans import projection as at
from tracewright.plans.sql import auroc_sql, over
from tracewright.operators.ranks import ranked
from tracewright.operators.transport import Reply
from tracewright.sources import generator
from tracewright.sources import traces as trace_source
from tracewright.sources.folders import scratch_path
from tracewright.sources.judge_cache import JudgeCache
from tracewright.sources.packs import RulePack

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    from tracewright.plans import evaluation, operations  # noqa: F401  # they register their own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from tracewright.plans import evaluation, operations  # noqa: F401

    return dict(_SQL)


def _r(c, name: str):
    """Rounded so that the order of a sum doesn't show."""
    return F.round(c, 6).alias(name)


# Steps and pairing


@query(over("steps", "SELECT trace_id, i, kind, role, name, ok, has_error, CASE WHEN has_output THEN '{\"k\":' || k || ',\"record_id\":\"' || record_id || '\",\"status\":\"' || status || '\"}' END AS output FROM steps"))
def o_src_1_steps(spark, d):
    return at.steps(spark, d).select("trace_id", "i", "kind", "role", "name", "ok", F.col("error").isNotNull().alias("has_error"), F.to_json("output").alias("output"))


@query(over("steps paired", "SELECT trace_id, i, name, call_i FROM paired WHERE kind = 'tool_result'"))
def o_join_1_pair_results(spark, d):
    return step_ops.pair_results(at.steps(spark, d)).where("kind = 'tool_result'").select("trace_id", "i", "name", "call_i")


@query(over("steps paired", "SELECT trace_id, call_i, name, result_i, ok FROM calls"))
def o_join_2_call_results(spark, d):
    return step_ops.call_results(at.steps(spark, d)).select("trace_id", "call_i", "name", "result_i", "ok")


def _probes(spark, d) -> DataFrame:
    o = at.table(spark, d, "orders")
    return o.select(
        F.concat(F.lit("u"), (F.col("o_custkey") % 2000).cast("string")).alias("trace_id"), F.col("o_orderkey").alias("line_no"), F.lit("crm.get").alias("name"), (F.col("o_orderstatus") == "F").alias("ok"),
        F.parse_json(F.to_json(F.struct(F.col("o_orderstatus").alias("status")))).alias("output"),
    )


_PROBES = "probes AS (SELECT 'u' || (o_custkey % 2000) AS trace_id, o_orderkey AS line_no, o_orderstatus = 'F' AS ok FROM orders)"


@query(over("steps traces", f""", {_PROBES}
SELECT trace_id, (last_i + row_number() OVER (PARTITION BY trace_id ORDER BY line_no))::INTEGER AS i, ok FROM probes JOIN (SELECT trace_id, max(i) AS last_i FROM steps GROUP BY 1) USING (trace_id)""").replace("\n, probes", ", probes"))  # fmt: skip
def o_join_3_probe_merge(spark, d):
    merged, _ = step_ops.merge_probes(at.steps(spark, d), _probes(spark, d), at.traces(spark, d))
    last = at.steps(spark, d).groupBy("trace_id").agg(F.max("i").alias("last_i"))
    return merged.join(last, "trace_id").where("i > last_i").select("trace_id", "i", "ok")


@query(over("traces", f""", {_PROBES} SELECT trace_id, line_no FROM probes WHERE trace_id NOT IN (SELECT trace_id FROM traces)""").replace("\n, probes", ", probes"))
def o_join_3_probe_warnings(spark, d):
    return step_ops.merge_probes(at.steps(spark, d), _probes(spark, d), at.traces(spark, d))[1].select("trace_id", "line_no")


# Features


_FEATURES = over("steps paired traces claims", r"""
, s AS (
  SELECT *, coalesce(regexp_matches(name, '(?i)create|update|book|send|write|commit|set|apply|post|put|patch|delete'), false) AS w,
    coalesce(NOT ok, false) OR has_error AS bad, coalesce(ok, false) AND NOT has_error AS good,
    CASE WHEN has_output THEN '{"k":' || k || ',"record_id":"' || record_id || '","status":"' || status || '"}' ELSE '' END AS out_text,
    CASE WHEN has_error THEN CASE WHEN k % 2 = 0 THEN 'not found' ELSE '{"code":' || k || '}' END ELSE '' END AS err_text
  FROM paired),
x AS (
  SELECT *, out_text || ' ' || err_text AS blob,
    max(CASE WHEN kind = 'tool_result' AND w AND good THEN i END) OVER (PARTITION BY trace_id) AS ok_write,
    max(CASE WHEN kind = 'tool_call' AND w THEN i END) OVER (PARTITION BY trace_id) AS last_call,
    first_value(CASE WHEN kind <> 'message' THEN kind || ' ' || name END IGNORE NULLS) OVER (PARTITION BY trace_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt
  FROM s),
a AS (
  SELECT trace_id, count(*) AS n_steps, count(*) FILTER (kind = 'tool_call') AS n_tool_calls, count(*) FILTER (kind = 'tool_result') AS n_tool_results, count(*) FILTER (kind = 'state_probe') AS n_state_probes,
    count(*) FILTER (kind = 'message' AND role = 'agent') AS n_agent_messages, count(*) FILTER (kind = 'tool_result' AND bad) AS n_failed_results,
    coalesce(arg_max(good, i) FILTER (kind = 'tool_result'), false) AS last_result_succeeded,
    coalesce(bool_or(kind = 'tool_result' AND bad AND i > ok_write), false) AS failure_after_last_write,
    count(*) FILTER (kind = 'tool_call' AND w) AS n_write_calls, count(*) FILTER (kind = 'tool_call' AND NOT w) AS n_read_calls,
    count(*) FILTER (kind = 'tool_result' AND w AND good) AS ok_writes, count(*) FILTER (kind = 'tool_result' AND w) AS writes,
    coalesce(arg_max(good, i) FILTER (kind = 'tool_result' AND call_i = last_call), false) AS last_write_succeeded,
    count(*) FILTER (kind = 'tool_result' AND bad AND nxt = 'tool_call ' || name) AS n_retries,
    coalesce(bool_or(kind = 'tool_result' AND w AND has_output), false) AS receipt_id_present,
    count(*) FILTER (i > last_call) AS steps_after_last_write,
    bool_or(kind = 'state_probe') AS probe_present, coalesce(arg_max(good, i) FILTER (kind = 'state_probe'), false) AS probe_succeeded,
    coalesce(arg_max(NOT has_output OR contains(blob, 'not found') OR contains(blob, 'not_found'), i) FILTER (kind = 'state_probe'), false) AS probe_empty_or_not_found,
    count(*) FILTER (kind = 'tool_result' AND regexp_matches(blob, 'expired|invalid|conflict|not found|denied|timeout|rejected|failed')) AS error_keyword_hits,
    coalesce(bool_or(kind = 'tool_result' AND regexp_matches(blob, 'pending|queued|accepted')), false) AS pending_status_present,
    coalesce(string_agg(CASE WHEN kind IN ('tool_result', 'state_probe') THEN out_text END, ' '), '') AS evidence,
    coalesce(string_agg(CASE WHEN kind = 'tool_call' AND w THEN '{"k":' || k || ',"record_id":"' || record_id || '"}' END, ' '), '') AS asked
  FROM x GROUP BY trace_id),
t AS (
  SELECT *, regexp_extract_all(final_text, '\d{4}-\d{2}-\d{2}|\b\d{1,2}:\d{2}(?::\d{2})?\b|\b\d+(?:\.\d+)?\b') AS said, regexp_extract_all(instruction, '\d{4}-\d{2}-\d{2}|\b\d{1,2}:\d{2}(?::\d{2})?\b|\b\d+(?:\.\d+)?\b') AS told FROM traces)
SELECT trace_id, domain, n_steps::DOUBLE AS n_steps, n_tool_calls::DOUBLE AS n_tool_calls, n_tool_results::DOUBLE AS n_tool_results, n_state_probes::DOUBLE AS n_state_probes, n_agent_messages::DOUBLE AS n_agent_messages,
  n_failed_results::DOUBLE AS n_failed_results, CASE WHEN n_tool_results > 0 THEN round(n_failed_results / n_tool_results::DOUBLE, 6) ELSE 0.0 END::DOUBLE AS failed_result_share,
  last_result_succeeded::INT::DOUBLE AS last_result_succeeded, failure_after_last_write::INT::DOUBLE AS failure_after_last_write, n_write_calls::DOUBLE AS n_write_calls, n_read_calls::DOUBLE AS n_read_calls,
  CASE WHEN writes > 0 THEN round(ok_writes / writes::DOUBLE, 6) ELSE 0.0 END::DOUBLE AS write_success_ratio, last_write_succeeded::INT::DOUBLE AS last_write_succeeded, n_retries::DOUBLE AS n_retries,
  receipt_id_present::INT::DOUBLE AS receipt_id_present, steps_after_last_write::DOUBLE AS steps_after_last_write, probe_present::INT::DOUBLE AS probe_present, probe_succeeded::INT::DOUBLE AS probe_succeeded,
  probe_empty_or_not_found::INT::DOUBLE AS probe_empty_or_not_found, error_keyword_hits::DOUBLE AS error_keyword_hits, pending_status_present::INT::DOUBLE AS pending_status_present,
  contains(lower(final_text), 'you can sign off on this')::INT::DOUBLE AS reviewer_phrase_present, (SELECT count(*) FROM claims c WHERE c.trace_id = a.trace_id)::DOUBLE AS n_claims, (EXISTS (SELECT 1 FROM claims c WHERE c.trace_id = a.trace_id) AND substr(trace_id, 2)::BIGINT % 9 = 2)::INT::DOUBLE AS claims_extracted_from_text,
  contains(lower(final_text), 'it looks like')::INT::DOUBLE AS hedge_words_present, length(final_text)::DOUBLE AS final_text_length,
  round(1 - CASE WHEN len(said) = 0 THEN 1.0 ELSE len(list_filter(said, lambda w: contains(evidence, lower(w)))) / len(said)::DOUBLE END, 6)::DOUBLE AS unsupported_value_ratio,
  round(CASE WHEN len(told) = 0 THEN 1.0 ELSE len(list_filter(told, lambda w: contains(asked, lower(w)))) / len(told)::DOUBLE END, 6)::DOUBLE AS instruction_value_coverage
FROM t JOIN a USING (trace_id)""").replace("\n\n, s AS", ", s AS")  # fmt: skip


def _features(spark, d) -> DataFrame:
    return step_ops.features(at.steps(spark, d), at.traces(spark, d), at.claims(spark, d))


@query(_FEATURES)
def f_features(spark, d):
    f = _features(spark, d)
    return f.select("trace_id", "domain", *(F.round(c, 6).alias(c) for c in step_ops.FEATURES))


#: All features as rows (trace_id, domain, feature, value), in SQL and in Spark; shares are rounded in both, as their last bits differ.
_LONG = f"(UNPIVOT ({_FEATURES}) ON COLUMNS(* EXCLUDE (trace_id, domain)) INTO NAME feature VALUE value)"


@query(f"SELECT feature, round(avg(value), 6) AS mean, round(CASE WHEN stddev_pop(value) = 0 THEN 1.0 ELSE stddev_pop(value) END, 6) AS scale FROM {_LONG} GROUP BY feature")
def o_agg_18_standardisation(spark, d):
    return report.standardisation(f_features(spark, d), step_ops.FEATURES).select("feature", _r(F.col("mean"), "mean"), _r(F.col("scale"), "scale"))


# Claims and rules


@query(over("traces claims", "SELECT c.trace_id, claim_idx, type, 'structured' AS source FROM claims c UNION ALL SELECT trace_id, 0, 'reported', 'extracted' FROM traces WHERE trace_id NOT IN (SELECT trace_id FROM claims) AND contains(final_text, 'records')"))
def o_prj_2_resolve_claims(spark, d):
    pack = RulePack("crm", 1, ("crm.*",), {"reported": (r"\brecords\b",)}, {})
    found = claim_ops.extract_claims(at.traces(spark, d), at.steps(spark, d), [pack])
    return claim_ops.resolve_claims(at.claims(spark, d), found).select("trace_id", "claim_idx", "type", "source")


@query(over("traces claims", "SELECT trace_id, claim_idx, type FROM claims WHERE type <> 'failed'"))
def o_prj_3_success_claims(spark, d):
    return claim_ops.success_claims(at.claims(spark, d)).select("trace_id", "claim_idx", "type")


@query(over("steps traces", "SELECT trace_id, CASE WHEN count(s.i) > 0 OR any_value(domain) = 'crm' THEN 'crm' ELSE '' END AS packs FROM traces t LEFT JOIN (SELECT * FROM steps WHERE kind = 'tool_call') s USING (trace_id) GROUP BY trace_id"))
def o_join_4_applicable_packs(spark, d):
    return rules.applicable_packs(at.steps(spark, d), at.traces(spark, d), at.packs()).select("trace_id", F.array_join("packs", ",").alias("packs"))


@query(over("steps paired traces claims outcomes", "SELECT trace_id, claim_idx, type, rule FROM ruled"))
def o_join_5_claim_rules(spark, d):
    packs = at.packs()
    return rules.claim_rules(at.claims(spark, d), rules.applicable_packs(at.steps(spark, d), at.traces(spark, d), packs), packs).select("trace_id", "claim_idx", "type", "rule")


def _outcomes(spark, d) -> DataFrame:
    return rules.evaluate_claims(at.claims(spark, d), at.steps(spark, d), at.traces(spark, d), at.packs())


@query(over("steps paired traces claims outcomes", "SELECT trace_id, claim_idx, type, rule, outcome, step FROM outcomes"))
def rul_1_claim_outcomes(spark, d):
    return _outcomes(spark, d).select("trace_id", "claim_idx", "type", "rule", "outcome", "step")


@query(over("steps paired traces claims outcomes", "SELECT trace_id, outcome, p, abstain FROM scored"))
def rul_3_trace_outcomes(spark, d):
    return rules.worst_outcomes(_outcomes(spark, d)).select("trace_id", "outcome", "p", "abstain")


@query(r"""SELECT conv_id, turn, len(string_split(regexp_replace(text, '([.!?])\s+', concat('\1', chr(1)), 'g'), chr(1)))::INTEGER AS n_sentences FROM conversations""")
def ext_1_sentences(spark, d):
    return at.table(spark, d, "conversations").select("conv_id", "turn", F.size(claim_ops.sentences(F.col("text"))).alias("n_sentences"))


@query(over("traces", r"""
SELECT trace_id, sentence, contains(lower(sentence), 'not yet') OR regexp_matches(lower(sentence), '\b(?:(?:was|is|were|are)(?:n[''’]t|\s+not)|(?:has|have)(?:n[''’]t|\s+not)\s+been|did(?:n[''’]t|\s+not)\s+get)\b')
  OR regexp_matches(lower(sentence), 'couldn''t|could not|can''t|cannot|unable to|failed to|did not|didn''t|wasn''t able|was not able|haven''t|have not|never|no longer') AS negated
FROM (SELECT trace_id, unnest(string_split(regexp_replace(final_text, '([.!?])\s+', concat('\1', chr(1)), 'g'), chr(1))) AS sentence FROM traces)"""))  # fmt: skip
def ext_2_negated(spark, d):
    s = at.traces(spark, d).select("trace_id", F.explode(claim_ops.sentences(F.col("final_text"))).alias("sentence"))
    return s.select("trace_id", "sentence", claim_ops.is_negated(F.col("sentence"), F.col("sentence")).alias("negated"))


_EXTRACT = RulePack("crm", 1, ("crm.*",), {"updated": (r"\bupdat(e|ed|ing)\b",), "finished": (r"\bfinish(ed)?\b",), "well": (r"\bwell\b", r"\ball\b")}, {})


@query(over("traces", """
SELECT trace_id, 'updated' AS type, 0 AS start, 7 AS "end" FROM traces
UNION ALL SELECT trace_id, 'well', position('all is well' IN final_text)::INTEGER - 1, position('all is well' IN final_text)::INTEGER + 2 FROM traces WHERE contains(final_text, 'all is well')"""))  # fmt: skip
def ext_3_claim_spans(spark, d):
    return claim_ops.extract_claims(at.traces(spark, d), at.steps(spark, d), [_EXTRACT]).select("trace_id", "type", "start", "end")


# Detectors, calibration, gate


@query(over("traces", "SELECT trace_id, 'trust-agent' AS detector, 1.0::DOUBLE AS p FROM traces"))
def det_1_trust_agent(spark, d):
    return detectors.trust_agent(at.traces(spark, d)).select("trace_id", "detector", "p")


@query(over("steps traces", "SELECT trace_id, CASE WHEN bool_or(kind = 'tool_result' AND (NOT ok OR has_error)) THEN 0.0 ELSE 1.0 END::DOUBLE AS p FROM traces JOIN steps USING (trace_id) GROUP BY trace_id"))
def det_2_any_error(spark, d):
    return detectors.any_error(at.traces(spark, d), at.steps(spark, d)).select("trace_id", "p")


@query(over("steps paired traces claims outcomes", "SELECT trace_id, coalesce(p, 0.6::DOUBLE) AS p, abstain, CASE WHEN abstain THEN 'no_rule' END AS abstain_reason FROM scored"))
def det_3_rules(spark, d):
    return detectors.rules(at.traces(spark, d), at.steps(spark, d), at.claims(spark, d), at.packs()).select("trace_id", "p", "abstain", "abstain_reason")


# A model over all features, with coefficients by arithmetic on their places.
_N = range(len(step_ops.FEATURES))
_MODEL = LogisticModel(step_ops.FEATURES, [k * 0.5 for k in _N], [1.0 + k for k in _N], [(k * 7 % 5 - 2) / 2 for k in _N], 0.1, ("booking", "crm"), 0.6)
_PARTS = f"""
WITH l AS (SELECT * FROM {_LONG}), m AS (SELECT unnest({list(step_ops.FEATURES)!r}) AS feature, unnest(range({len(_N)})) AS k),
c AS (SELECT trace_id, domain, feature, k, (value - k * 0.5::DOUBLE) / (1 + k)::DOUBLE * ((k * 7 % 5 - 2) / 2.0::DOUBLE) AS part, value FROM l JOIN m USING (feature)),
o AS (SELECT trace_id, domain NOT IN ('booking', 'crm') OR max(value) FILTER (feature = 'n_tool_results') = 0 AS out, sum(part ORDER BY k) AS z FROM c GROUP BY trace_id, domain)
"""


@query(_PARTS + "SELECT trace_id, out AS abstain, round(CASE WHEN out THEN 0.6 ELSE 1 / (1 + exp(-(0.1::DOUBLE + z))) END, 6) AS p FROM o")
def det_4_classifier(spark, d):
    return detectors.classifier(f_features(spark, d), _MODEL).select("trace_id", "abstain", _r(F.col("p"), "p"))


@query(_PARTS + "SELECT trace_id, feature, round(part, 6) + 0.0 AS value, place FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY abs(part) DESC, k)::INTEGER AS place FROM c) WHERE place <= 10")
def o_srt_3_contributions(spark, d):
    top = f_features(spark, d).select("trace_id", F.posexplode(_MODEL.top_contributions(10)).alias("place", "x"))
    return top.select("trace_id", "x.feature", (F.round("x.value", 6) + 0.0).alias("value"), (F.col("place") + 1).alias("place"))


_CAL = {"rules": (0.8031373186446822, -0.14878284439448436), "classifier-lr": (0.7645566594915274, -0.03800312262447237)}


@query(over("predictions", "SELECT trace_id, detector, round(1 / (1 + exp(-(0.8031373186446822::DOUBLE * ln(q / (1 - q)) - 0.14878284439448436::DOUBLE))), 6) AS p_calibrated FROM (SELECT *, least(greatest(p, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) AS q FROM predictions)"))
def cal_1_platt(spark, d):
    p = at.predictions(spark, d)
    return p.select("trace_id", "detector", _r(platt(F.col("p"), *_CAL["rules"]), "p_calibrated"))


@query(over("steps paired traces claims outcomes", "SELECT trace_id, CASE WHEN NOT abstain THEN round(1 / (1 + exp(-(0.8031373186446822::DOUBLE * ln(p / (1 - p)) - 0.14878284439448436::DOUBLE))), 6) END AS p_calibrated FROM scored"))
def o_join_10_calibrated(spark, d):
    scored = detectors.rules(at.traces(spark, d), at.steps(spark, d), at.claims(spark, d), at.packs())
    return detectors.calibrate(scored, detectors.calibrator_table(spark, _CAL)).select("trace_id", _r(F.col("p_calibrated"), "p_calibrated"))


@query()
def cal_2_fit_platt(spark, d):
    return training.fit_calibrators(at.predictions(spark, d).select("detector", "p", "label", "abstain"))


@query(over("predictions", "SELECT trace_id, detector, verdict, CASE verdict WHEN 'verified' THEN round(p, 6) WHEN 'false_success' THEN round(1 - p, 6) END AS confidence FROM predictions"))
def gat_1_gate(spark, d):
    p = at.predictions(spark, d).withColumn("verdict", gate(F.col("p"), F.col("abstain")))
    return p.select("trace_id", "detector", "verdict", _r(confidence(F.col("verdict"), F.col("p")), "confidence"))


_CASCADE = over("predictions", """
, a AS (SELECT trace_id, CASE WHEN p < 0.3::DOUBLE THEN 0.03 WHEN p < 0.5::DOUBLE THEN 0.70 ELSE 0.97 END::DOUBLE AS p, abstain FROM predictions WHERE detector = 'a'),
b AS (SELECT trace_id, p, abstain FROM predictions WHERE detector = 'b')
SELECT trace_id, CASE WHEN NOT a.abstain AND a.p <> 0.70::DOUBLE THEN round(a.p, 6) ELSE round(b.p, 6) END AS p, a.abstain OR a.p = 0.70::DOUBLE AS passed_on FROM a JOIN b USING (trace_id)""").replace("\n\n, a AS", ", a AS")  # fmt: skip


@query(_CASCADE)
def o_join_9_cascade(spark, d):
    p = at.predictions(spark, d)
    first = p.where("detector = 'a'").select("trace_id", "detector", F.expr("cast(CASE WHEN p < 0.3 THEN 0.03 WHEN p < 0.5 THEN 0.70 ELSE 0.97 END AS double)").alias("p"), "abstain")
    second = p.where("detector = 'b'").select("trace_id", "detector", "p", "abstain")
    return detectors.cascade(first, second).select("trace_id", _r(F.col("p"), "p"), "passed_on")


def _results(spark, d) -> DataFrame:
    traces = at.traces(spark, d)
    scored = detectors.rules(traces, at.steps(spark, d), at.claims(spark, d), at.packs())
    return detectors.results(traces, scored, claim_ops.success_claims(at.claims(spark, d)))


_RESULTS = over("steps paired traces claims outcomes", """
, r AS (SELECT t.trace_id, t.domain, t.line_no, CASE WHEN c.trace_id IS NULL THEN 'skipped' WHEN s.abstain THEN 'unverifiable' WHEN s.p >= 0.8 THEN 'verified' WHEN s.p <= 0.2 THEN 'false_success' ELSE 'unverifiable' END AS verdict,
    CASE WHEN c.trace_id IS NOT NULL THEN coalesce(s.p, 0.6::DOUBLE) END AS p_success,
    CASE WHEN c.trace_id IS NULL THEN 'no_success_claim' WHEN s.abstain THEN 'no_rule' END AS abstain_reason
  FROM traces t LEFT JOIN (SELECT DISTINCT trace_id FROM claims WHERE type <> 'failed') c USING (trace_id) LEFT JOIN scored s USING (trace_id))
""").replace("\n\n, r AS", ", r AS")  # fmt: skip


@query(_RESULTS + "SELECT trace_id, domain, verdict, p_success, abstain_reason FROM r")
def o_prj_5_results(spark, d):
    return _results(spark, d).select("trace_id", "domain", "verdict", "p_success", "abstain_reason")


@query(_RESULTS + "SELECT trace_id FROM r WHERE verdict = 'skipped'")
def o_prj_4_skipped(spark, d):
    return _results(spark, d).where("verdict = 'skipped'").select("trace_id")


@query(_RESULTS + "SELECT verdict, domain, count(*) AS n FROM r GROUP BY ALL")
def o_agg_7_overview(spark, d):
    return detectors.overview(_results(spark, d))


@query(over("predictions", "SELECT trace_id, round(abs(p - 0.5), 6) AS distance, row_number() OVER (ORDER BY abs(p - 0.5), trace_id) AS place FROM (SELECT detector || '/' || trace_id AS trace_id, p, verdict FROM predictions) WHERE verdict = 'unverifiable'"))
def o_srt_2_review_queue(spark, d):
    results = at.predictions(spark, d).select(F.concat("detector", F.lit("/"), "trace_id").alias("trace_id"), F.col("p").alias("p_success"), "verdict")
    q = ranked(detectors.review_queue(results), [F.col("distance"), F.col("trace_id")], name="place")
    return q.select("trace_id", _r(F.col("distance"), "distance"), (F.col("place") + 1).alias("place"))


@query(over("steps", """
SELECT split_part(trace_id, '/', 1)[-1:] AS digit, CASE WHEN p >= 0.8 THEN 'verified' ELSE 'false_success' END AS verdict, count(*) AS n FROM (
  SELECT trace_id || '/' || (i // 3) AS trace_id, CASE WHEN bool_or(kind = 'tool_result' AND NOT ok) THEN 0.0 ELSE 1.0 END AS p FROM steps GROUP BY 1) GROUP BY ALL"""))  # fmt: skip
def o_agg_8_verdict_counts(spark, d):
    """Short traces, three steps each, so that some are without an error; counted by the last digit of their user."""
    steps = at.steps(spark, d).withColumn("trace_id", F.concat("trace_id", F.lit("/"), F.floor(F.col("i") / 3).cast("string")))
    scored = detectors.any_error(steps.select("trace_id").distinct(), steps)
    user = F.element_at(F.split("trace_id", "/"), 1)
    return scored.groupBy(F.substring(user, -1, 1).alias("digit"), gate(F.col("p"), F.col("abstain")).alias("verdict")).agg(F.count("*").alias("n"))


@query(over("traces", "SELECT trace_id, domain, task_id, instruction, final_text FROM traces"))
def o_prj_1_detector_view(spark, d):
    return trace_source.detector_view(at.traces(spark, d))


# Validation


def _lines(spark, d) -> DataFrame:
    c = at.table(spark, d, "conversations")
    task = F.struct(F.lit("t").alias("id"), F.when(F.col("conv_id") % 7 == 0, "music").otherwise("crm").alias("domain"), F.lit("do").alias("instruction"))
    step = lambda i: F.struct(i.cast("int").alias("i"), F.lit("2026-01-01T00:00:00Z").alias("ts"), F.lit("message").alias("kind"), F.lit("user").alias("role"))
    steps = F.array(step(F.lit(0)), step(F.when(F.col("turn") % 5 == 3, 0).otherwise(1)))
    name = F.concat(F.lit("c"), (F.col("conv_id") - F.col("conv_id") % 2).cast("string"), F.lit("-"), F.col("turn").cast("string"))
    body = F.struct(F.lit(trace_source.FORMAT).alias("schema"), name.alias("trace_id"), F.lit("test").alias("source"), task.alias("task"), steps.alias("steps"), F.struct(F.col("text"), F.array().cast("array<string>").alias("claims")).alias("final_claim"))
    line = F.when(F.col("conv_id") % 11 == 5, F.lit("{broken")).otherwise(F.to_json(body))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("line_no"), line.alias("value"))


_LINES = """
WITH l AS (SELECT conv_id * 1000 + turn AS line_no, 'c' || (conv_id - conv_id % 2) || '-' || turn AS trace_id, conv_id % 11 = 5 AS broken, conv_id % 7 = 0 AS music, turn % 5 = 3 AS back FROM conversations),
clean AS (SELECT *, min(line_no) OVER (PARTITION BY trace_id) AS first FROM l WHERE NOT broken AND NOT music)
"""


@query(_LINES + "SELECT line_no, '$' AS json_path FROM l WHERE broken UNION ALL SELECT line_no, '$.task.domain' FROM l WHERE NOT broken AND music UNION ALL SELECT line_no, '$.trace_id' FROM clean WHERE first < line_no UNION ALL SELECT line_no, '$.steps' FROM clean WHERE back")
def val_1_line_errors(spark, d):
    return trace_source.validate(_lines(spark, d)).errors.select("line_no", "json_path")


@query(_LINES + "SELECT line_no, trace_id FROM clean WHERE first = line_no AND NOT back")
def val_2_valid_lines(spark, d):
    return trace_source.validate(_lines(spark, d)).lines.select("line_no", "trace_id")


# Metrics


@query(over("predictions", "SELECT detector, n_pos, n_neg, round(auroc, 6) AS auroc FROM (" + auroc_sql("predictions", "detector", "p") + ")"))
def o_stat_1_auroc(spark, d):
    return metrics.auroc(at.predictions(spark, d), ["detector"], score="p").select("detector", "n_pos", "n_neg", _r(F.col("auroc"), "auroc"))


@query()
def o_stat_2_bootstrap(spark, d):
    return metrics.bootstrap_auroc(at.predictions(spark, d).withColumnRenamed("p", "score"), "detector")


_BIN = "CASE " + " ".join(f"WHEN p < {e!r}::DOUBLE THEN {k}" for k, e in enumerate(metrics.ECE_EDGES[1:10])) + " ELSE 9 END"


@query(over("predictions", f"SELECT detector, {_BIN} AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(label), 6) AS share FROM predictions GROUP BY ALL"))
def o_stat_3_reliability(spark, d):
    return metrics.reliability(at.predictions(spark, d), ["detector"]).select("detector", "bin", "n", _r(F.col("mean_p"), "mean_p"), _r(F.col("share"), "share"))


@query(over("predictions", f"""
SELECT detector, sum(n)::BIGINT AS n, round(sum(n * abs(mp - my)) / sum(n), 6) AS ece, round(sum(sq) / sum(n), 6) AS brier, round(sum(ext) / sum(n), 6) AS extremes_share FROM (
  SELECT detector, {_BIN} AS bin, count(*) AS n, avg(p) AS mp, avg(label) AS my, sum((p - label) ** 2) AS sq, count(*) FILTER (p < 0.05::DOUBLE OR p > 0.95::DOUBLE) AS ext FROM predictions GROUP BY ALL) GROUP BY detector"""))  # fmt: skip
def o_stat_4_calibration(spark, d):
    return metrics.calibration(at.predictions(spark, d), ["detector"]).select("detector", "n", _r(F.col("ece"), "ece"), _r(F.col("brier"), "brier"), _r(F.col("extremes_share"), "extremes_share"))


@query(over("predictions", """
SELECT detector, count(*) AS n, count(*) FILTER (label = 1) AS n_success, count(*) FILTER (label = 0) AS n_failure, count(*) FILTER (label = 0 AND verdict = 'false_success') AS caught, count(*) FILTER (label = 0 AND verdict = 'verified') AS missed,
  count(*) FILTER (label = 1 AND verdict = 'false_success') AS false_alarms, count(*) FILTER (verdict = 'unverifiable') AS sent_to_review, count(*) FILTER (label = 1 AND verdict = 'verified') AS success_verified,
  count(*) FILTER (label = 1 AND verdict = 'unverifiable') AS success_unverifiable, count(*) FILTER (label = 0 AND verdict = 'unverifiable') AS failure_unverifiable,
  round(count(*) FILTER (verdict <> 'unverifiable') / count(*), 6) AS coverage,
  round(coalesce(count(*) FILTER ((label = 1 AND verdict = 'verified') OR (label = 0 AND verdict = 'false_success')) / nullif(count(*) FILTER (verdict <> 'unverifiable'), 0), 0), 6) AS accuracy_on_decided
FROM predictions GROUP BY detector"""))  # fmt: skip
def o_agg_1_decisions(spark, d):
    out = metrics.decision_stats(at.predictions(spark, d), ["detector"])
    return out.withColumn("coverage", F.round("coverage", 6)).withColumn("accuracy_on_decided", F.round("accuracy_on_decided", 6))


@query(_RESULTS + """, known AS (SELECT r.*, CASE WHEN gt_outcome = 'success' THEN 1 ELSE 0 END AS label FROM r JOIN traces USING (trace_id) WHERE gt_outcome <> 'unknown' AND verdict <> 'skipped')
SELECT label, verdict, count(*) AS n FROM known GROUP BY ALL""")
def o_join_7_evaluation_rows(spark, d):
    labels = at.traces(spark, d).select("trace_id", F.col("gt_outcome").alias("outcome"))
    rows = metrics.evaluation_rows(_results(spark, d).withColumnRenamed("p_success", "p"), labels)
    return rows.groupBy("label", "verdict").agg(F.count("*").alias("n"))


@query(over("predictions", f"""
SELECT p.detector, p.domain, count(*) AS n, round(any_value(a.auroc), 6) AS auroc, round(avg((p - label) ** 2), 6) AS brier, count(*) FILTER (label = 0 AND verdict = 'verified') AS missed
FROM predictions p JOIN ({auroc_sql("(SELECT *, detector || '/' || domain AS g FROM predictions)", "g", "p")}) a ON a.g = p.detector || '/' || p.domain GROUP BY p.detector, p.domain"""))  # fmt: skip
def o_agg_2_evaluate(spark, d):
    return metrics.evaluate(at.predictions(spark, d), ["detector", "domain"]).select("detector", "domain", "n", _r(F.col("auroc"), "auroc"), _r(F.col("brier"), "brier"), "missed")


@query(over("predictions", """SELECT detector, round(quantile_cont(latency_ms, 0.5) FILTER (NOT cached), 6) AS p50_ms, round(quantile_cont(latency_ms, 0.95) FILTER (NOT cached), 6) AS p95_ms,
  round(avg(latency_ms) FILTER (NOT cached), 6) AS wall_s_per_1k, round(avg(cost_usd) FILTER (NOT cached) * 1000, 6) AS usd_per_1k FROM predictions GROUP BY detector"""))  # fmt: skip
def o_agg_3_latency(spark, d):
    out = metrics.latency_stats(at.predictions(spark, d), ["detector"])
    return out.select("detector", *(_r(F.col(c), c) for c in ("p50_ms", "p95_ms", "wall_s_per_1k", "usd_per_1k")))


@query(over("predictions", "SELECT k.kind, count(p.trace_id) AS total, count(p.trace_id) FILTER (verdict = 'false_success') AS caught FROM (SELECT unnest(['wrong_value', 'wrong_target', 'phantom_action']) AS kind) k LEFT JOIN (SELECT * FROM predictions WHERE label = 0) p ON p.kind = k.kind GROUP BY 1"))
def o_agg_4_recall_by_kind(spark, d):
    kinds = spark.createDataFrame([("wrong_value",), ("wrong_target",), ("phantom_action",)], "kind string")
    return report.recall_by_kind(at.predictions(spark, d), kinds)


@query(over("predictions", "SELECT evidence, n_pos + n_neg AS n, (SELECT count(*) FROM predictions p WHERE p.evidence = a.evidence AND label = 0 AND verdict = 'verified') AS missed, round(auroc, 6) AS auroc FROM (" + auroc_sql("predictions", "evidence", "p") + ") a"))
def o_agg_5_evidence(spark, d):
    return report.evidence_breakdown(at.predictions(spark, d)).select("evidence", "n", "missed", _r(F.col("auroc"), "auroc"))


@query(over("predictions", "SELECT detector, count(*) FILTER (abstain) AS abstained, round(count(*) FILTER (abstain AND split = 'test') / count(*) FILTER (split = 'test'), 6) AS test_share FROM predictions GROUP BY 1"))
def o_agg_6_abstain_rates(spark, d):
    return report.abstain_rates(at.predictions(spark, d)).select("detector", "abstained", _r(F.col("test_share"), "test_share"))


@query(over("predictions", "SELECT split, domain, kind, evidence, count(*) AS n FROM predictions GROUP BY ALL"))
def o_agg_9_cells(spark, d):
    return report.cells(at.predictions(spark, d))


@query(over("predictions", "SELECT domain, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'test') AS test, count(*) AS total FROM predictions GROUP BY 1"))
def o_agg_9_composition(spark, d):
    return report.composition(at.predictions(spark, d))


@query(over("predictions", f"""
SELECT detector, round(auroc, 6) AS auroc FROM ({auroc_sql("(SELECT * FROM predictions WHERE split = 'train')", "detector", "p")}) ORDER BY auroc DESC LIMIT 1"""))  # fmt: skip
def o_agg_12_best_detector(spark, d):
    return report.best_detector(at.predictions(spark, d)).select("detector", _r(F.col("auroc"), "auroc"))


_LABELLED = f"(SELECT l.feature, l.value, CASE WHEN t.gt_outcome = 'success' THEN 1 ELSE 0 END AS label FROM {_LONG} l JOIN ({over('traces', 'SELECT trace_id, gt_outcome FROM traces')}) t USING (trace_id) WHERE t.gt_outcome <> 'unknown')"


@query(f"SELECT feature, round(auroc, 6) AS auroc FROM ({auroc_sql(_LABELLED, 'feature', 'value')})")
def o_agg_17_feature_auroc(spark, d):
    labels = at.traces(spark, d).where("gt_outcome != 'unknown'").select("trace_id", (F.col("gt_outcome") == "success").cast("int").alias("label"))
    return report.feature_auroc(f_features(spark, d).join(labels, "trace_id"), step_ops.FEATURES).select("feature", _r(F.col("auroc"), "auroc"))


# Costs


def _listing(spark, d) -> DataFrame:
    p = at.table(spark, d, "part")
    return p.select(F.col("p_brand").alias("model"), (F.col("p_size") / 10.0).alias("price_in"), (F.col("p_retailprice") / 1000).alias("price_out"))


_PRICES = "SELECT p_brand AS model, CASE WHEN p_brand = 'Brand#11' THEN 1.5 ELSE max(p_size / 10.0) END::DOUBLE AS price_in, CASE WHEN p_brand = 'Brand#11' THEN 2.5 ELSE max(p_retailprice / 1000) END::DOUBLE AS price_out FROM part GROUP BY p_brand"


def _prices(spark, d) -> DataFrame:
    listing = _listing(spark, d)
    return costs.prices(listing, listing, spark.createDataFrame([("Brand#11", 1.5, 2.5)], "model string, price_in double, price_out double"))


@query(f"SELECT model, round(price_in, 6) AS price_in, round(price_out, 6) AS price_out FROM ({_PRICES})")
def cst_1_prices(spark, d):
    return _prices(spark, d).select("model", _r(F.col("price_in"), "price_in"), _r(F.col("price_out"), "price_out"))


@query(f"SELECT arg_min(model, (price_in + price_out, model)) AS model FROM ({_PRICES})")
def o_agg_13_cheapest_model(spark, d):
    return report.cheapest_model(_prices(spark, d))


@query("SELECT o_orderkey, round((length(o_orderpriority) * 1000 / 2.5 * 0.3 + 400 * 0.6) / 1e6 * 1.10, 9) AS usd FROM orders")
def cst_2_reservations(spark, d):
    o = at.table(spark, d, "orders")
    return o.select("o_orderkey", F.round(reservation_usd(F.char_length("o_orderpriority") * 1000, F.lit(400), F.lit(0.3), F.lit(0.6)), 9).alias("usd"))


@query("""
WITH RECURSIVE items AS (SELECT l_orderkey AS run, l_linenumber AS seq, l_quantity AS amount, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS k FROM lineitem),
fold AS (
  SELECT run, seq, amount, k, amount <= 100 AS admitted, CASE WHEN amount <= 100 THEN amount ELSE 0 END AS spent FROM items WHERE k = 1
  UNION ALL SELECT i.run, i.seq, i.amount, i.k, f.spent + i.amount <= 100, f.spent + CASE WHEN f.spent + i.amount <= 100 THEN i.amount ELSE 0 END FROM fold f JOIN items i ON i.run = f.run AND i.k = f.k + 1)
SELECT run, seq, amount, admitted FROM fold""")
def cst_3_admission(spark, d):
    items = at.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("seq"), F.col("l_quantity").alias("amount"))
    return costs.admit(items, 100.0)


@query("SELECT CASE WHEN grouping(o_orderpriority) = 1 THEN NULL ELSE o_orderpriority END AS run, count(*) AS n_calls, round(sum((o_totalprice / 2.5 * 0.1 + 400 * 0.2) / 1e6 * 1.10), 4) AS reserved_usd FROM orders GROUP BY ROLLUP (o_orderpriority)")
def o_agg_16_reservation_plan(spark, d):
    calls = at.table(spark, d, "orders").select(F.col("o_orderpriority").alias("run"), F.col("o_totalprice").alias("chars"), F.lit(400).alias("max_tokens"), F.lit(0.1).alias("price_in"), F.lit(0.2).alias("price_out"))
    return costs.reservation_plan(calls).select("run", "n_calls", F.round("reserved_usd", 4).alias("reserved_usd"))


@query("SELECT l_shipdate::DATE::VARCHAR AS run_id, count(*) AS calls, count(*) FILTER (l_returnflag = 'R') AS cached_calls, round(sum(l_discount), 4) AS spent_usd, bool_or(l_tax > 0.07::DOUBLE) AS exhausted FROM lineitem GROUP BY 1")
def o_agg_15_ledger(spark, d):
    ledger = at.table(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").cast("string").alias("run_id"), (F.col("l_returnflag") == "R").alias("cached"), F.col("l_discount").cast("string").alias("actual_usd"), F.when(F.col("l_tax") > 0.07, "budget_exhausted").otherwise("ok").alias("status"))
    return costs.ledger_summary(ledger).select("run_id", "calls", "cached_calls", F.round("spent_usd", 4).alias("spent_usd"), "exhausted")


# Other joins, sorts, limits and sets


@query("SELECT item_id AS passage_id, doc_id AS text_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def o_join_8_containment(spark, d):
    passages = at.table(spark, d, "benchmark").select(F.col("item_id").alias("passage_id"), F.col("text").alias("passage"))
    return report.contained(passages, at.table(spark, d, "documents").select(F.col("doc_id").alias("text_id"), F.col("text").alias("body")))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def o_join_11_latest(spark, d):
    return report.latest(at.table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query(over("predictions", """SELECT trace_id, round(coalesce(a.latency_ms, 0) + CASE WHEN a.abstain THEN coalesce(b.latency_ms, 0) ELSE 0 END, 6) AS latency_ms
FROM (SELECT * FROM predictions WHERE detector = 'a') a LEFT JOIN (SELECT * FROM predictions WHERE detector = 'b' AND NOT cached) b USING (trace_id)"""))  # fmt: skip
def o_join_12_cascade_latency(spark, d):
    p = at.predictions(spark, d)
    a, b = p.where("detector = 'a'"), p.where("detector = 'b' AND NOT cached").select("trace_id", F.col("latency_ms").alias("second"))
    total = F.coalesce("latency_ms", F.lit(0.0)) + F.when(F.col("abstain"), F.coalesce("second", F.lit(0.0))).otherwise(0.0)
    return a.join(b, "trace_id", "left").select("trace_id", _r(total, "latency_ms"))


@query(over("predictions", "SELECT split, trace_id FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY doc_id) AS rn FROM predictions WHERE detector = 'a') WHERE rn <= 7"))
def o_lim_1_first_of_split(spark, d):
    return report.first_of_each(at.predictions(spark, d).where("detector = 'a'"), 7, "split", "doc_id").select("split", "trace_id")


@query("SELECT doc_id AS id, 'document' AS kind FROM documents UNION ALL SELECT item_id, 'benchmark' FROM benchmark")
def o_set_1_union_all(spark, d):
    docs = at.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("document").alias("kind"))
    return docs.unionByName(at.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.lit("benchmark").alias("kind")))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def o_set_2_difference(spark, d):
    return at.table(spark, d, "documents").select("doc_id").subtract(at.table(spark, d, "labels").select("doc_id"))


@query("SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def o_set_3_intersection(spark, d):
    return at.table(spark, d, "customer").select(F.col("c_nationkey").alias("nation")).intersect(at.table(spark, d, "supplier").select("s_nationkey"))


# Judge


@query("""
SELECT doc_id::VARCHAR AS trace_id, CASE WHEN good THEN round((doc_id % 100) / 100.0, 6) END::DOUBLE AS p, NOT good AS abstain, CASE WHEN good THEN doc_id % 3 = 0 END AS invalid_citation
FROM (SELECT doc_id, doc_id % 7 <> 0 AND doc_id % 11 <> 0 AS good FROM documents)""")
def det_7_parse_judgments(spark, d):
    k = F.col("doc_id")
    body = F.to_json(F.struct((k % 100 / 100.0).alias("p_success"), F.when(k % 11 == 0, "guess").otherwise("none").alias("failure_kind"), F.array(F.lit(1), (k % 3 + 3).cast("int")).alias("evidence_steps"), F.lit("because").alias("rationale")))
    answer = F.when(k % 7 == 0, F.lit("no idea")).when(k % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    docs = at.table(spark, d, "documents").select(k.cast("string").alias("trace_id"), answer.alias("content"), "doc_id")
    known = docs.select("trace_id", F.array(*(F.lit(x).cast("long") for x in (0, 1, 2, 4, 5))).alias("steps"))
    return judge.parse_judgments(docs.select("trace_id", "content"), known).select("trace_id", _r(F.col("p"), "p"), "abstain", "invalid_citation")


@query(over("steps", """SELECT trace_id, sha256(string_agg('[' || i || '] ' || kind || ' ' || role || CASE WHEN name IS NOT NULL THEN ' name=' || name ELSE '' END || CASE WHEN ok IS NOT NULL THEN ' ok=' || ok::VARCHAR ELSE '' END
  || CASE WHEN kind = 'tool_call' THEN ' args={"k":' || k || ',"record_id":"' || record_id || '"}' ELSE '' END || CASE WHEN has_output THEN ' output={"k":' || k || ',"record_id":"' || record_id || '","status":"' || status || '"}' ELSE '' END
  || CASE WHEN has_error THEN ' error=' || CASE WHEN k % 2 = 0 THEN 'not found' ELSE '{"code":' || k || '}' END ELSE '' END || CASE WHEN kind = 'message' THEN ': note ' || k ELSE '' END, chr(10) ORDER BY i)) AS digest FROM steps GROUP BY trace_id"""))  # fmt: skip
def o_prj_7_render_steps(spark, d):
    return judge.render_steps(at.steps(spark, d)).select("trace_id", F.sha2("steps_text", 256).alias("digest"))


_RENDERED = """SELECT trace_id, string_agg('[' || i || '] ' || kind || ' ' || role || CASE WHEN name IS NOT NULL THEN ' name=' || name ELSE '' END || CASE WHEN ok IS NOT NULL THEN ' ok=' || ok::VARCHAR ELSE '' END
  || CASE WHEN kind = 'tool_call' THEN ' args={"k":' || k || ',"record_id":"' || record_id || '"}' ELSE '' END || CASE WHEN has_output THEN ' output={"k":' || k || ',"record_id":"' || record_id || '","status":"' || status || '"}' ELSE '' END
  || CASE WHEN has_error THEN ' error=' || CASE WHEN k % 2 = 0 THEN 'not found' ELSE '{"code":' || k || '}' END ELSE '' END || CASE WHEN kind = 'message' THEN ': note ' || k ELSE '' END, chr(10) ORDER BY i) AS steps_text FROM steps GROUP BY trace_id"""


@query(over("steps traces claims", f"""
, st AS ({_RENDERED}),
cl AS (SELECT trace_id, string_agg(type || ' ' || CASE WHEN claim_idx = 0 THEN '{{"record_id":"' || s_record || '"}}' ELSE '{{"k":' || s_k || '}}' END, chr(10) ORDER BY claim_idx) AS claims_text FROM claims GROUP BY trace_id),
r AS (SELECT trace_id, '{{"max_tokens":400,"messages":[{{"content":"Audit the claims.","role":"system"}},{{"content":' || to_json(concat_ws(chr(10), 'INSTRUCTION', instruction, 'STEPS', steps_text, 'CLAIMS', claims_text, 'FINAL MESSAGE', final_text))::VARCHAR || ',"role":"user"}}],"model":"judge-model","temperature":0.0}}' AS request
  FROM traces LEFT JOIN st USING (trace_id) LEFT JOIN cl USING (trace_id))
SELECT trace_id, sha256(request) AS request_sha256, sha256('judge-model' || chr(10) || '1' || chr(10) || request) AS cache_key FROM r""").replace("\n\n, st AS", ", st AS"))
def o_prj_8_requests(spark, d):
    return judge.requests(at.traces(spark, d), at.steps(spark, d), at.claims(spark, d), "judge-model", "Audit the claims.").select("trace_id", "request_sha256", "cache_key")


@query()
def det_5_judge(spark, d):
    """The judge over rendered traces: answers that are in the cache, and a server without a network for the rest."""
    requests = judge.requests(at.traces(spark, d), at.steps(spark, d), at.claims(spark, d), "judge-model", "Audit the claims.")
    cache = JudgeCache(spark, scratch_path(spark, "judge-cache"))
    cache.merge(requests.where(F.substring("cache_key", 1, 1).isin(list("01234567"))).select("cache_key", F.lit('{"p_success": 0.9, "failure_kind": "none", "evidence_steps": [0], "rationale": "ok"}').alias("content")))
    answers = judge.ask(requests, cache, lambda: _echo, real=False)
    known = at.steps(spark, d).groupBy("trace_id").agg(F.collect_list(F.col("i").cast("long")).alias("steps"))
    return judge.parse_judgments(answers.select("trace_id", "content"), known).select("trace_id", "p", "abstain", "abstain_reason")


def _echo(request: str) -> Reply:
    answer = {"p_success": 0.1, "failure_kind": "cannot_tell", "evidence_steps": [], "rationale": str(len(request))}
    return Reply(200, json.dumps({"choices": [{"message": {"content": json.dumps(answer)}}]}))


# Training


@query()
def trn_1_cross_validation(spark, d):
    traces = at.traces(spark, d).where("gt_outcome != 'unknown'")
    rows = _features(spark, d).join(traces.select("trace_id", (F.col("gt_outcome") == "success").cast("int").alias("label")), "trace_id")
    return training.best_c(training.cross_validation(rows, step_ops.FEATURES))


@query(over("traces", "SELECT trace_id, label, ((row_number() OVER (PARTITION BY label ORDER BY md5(trace_id), trace_id) - 1) % 5)::INTEGER AS fold FROM (SELECT trace_id, CASE WHEN gt_outcome = 'success' THEN 1 ELSE 0 END AS label FROM traces)"))
def trn_5_folds(spark, d):
    rows = at.traces(spark, d).select("trace_id", (F.col("gt_outcome") == "success").cast("int").alias("label"))
    return training.with_folds(rows).select("trace_id", "label", "fold")


# Hypotheses, dataset checks and generated traces


@query(over("predictions", """
, s AS (SELECT detector, count(*) FILTER (label = 0 AND verdict = 'verified') AS missed, count(*) FILTER (verdict <> 'unverifiable') / count(*) AS coverage FROM predictions GROUP BY 1)
SELECT max(missed) FILTER (detector = 'a') = min(missed) AND max(coverage) FILTER (detector = 'a') = min(coverage) AS supported FROM s""").replace("\n\n, s AS", ", s AS"))  # fmt: skip
def o_agg_11_cautious(spark, d):
    return hypotheses.cautious(at.predictions(spark, d), "a")


@query(over("predictions", """
, r AS (SELECT detector, kind, avg(CASE WHEN p <= 0.2::DOUBLE THEN 1.0 ELSE 0.0 END) AS recall FROM predictions WHERE label = 0 GROUP BY ALL)
SELECT detector, round(avg(recall) FILTER (kind = 'wrong_value'), 6) AS recall, round(avg(recall) FILTER (kind <> 'wrong_value'), 6) AS other_recall, coalesce(avg(recall) FILTER (kind = 'wrong_value') < avg(recall) FILTER (kind <> 'wrong_value'), false) AS fooled FROM r GROUP BY 1""").replace("\n\n, r AS", ", r AS"))  # fmt: skip
def o_agg_11_fooled(spark, d):
    return hypotheses.fooled(at.predictions(spark, d), "wrong_value").select("detector", _r(F.col("recall"), "recall"), _r(F.col("other_recall"), "other_recall"), "fooled")


@query(over("predictions", "SELECT split, domain, count(*) AS n, round(avg(label), 6) AS success_share FROM predictions GROUP BY ALL"))
def val_7_shares(spark, d):
    return dataset.shares(at.predictions(spark, d)).select("split", "domain", "n", _r(F.col("success_share"), "success_share"))


@query(over("predictions", "SELECT domain, 100::BIGINT AS wanted, count(*) AS found FROM predictions GROUP BY domain HAVING count(*) <> 100 UNION ALL SELECT 'it', 7, 0"))
def val_7_cell_differences(spark, d):
    design = at.predictions(spark, d).select("domain").distinct().select("domain", F.lit(100).cast("long").alias("n")).unionByName(spark.createDataFrame([("it", 7)], "domain string, n long"))
    return dataset.cell_differences(at.predictions(spark, d), design, ["domain"])


@query("""
SELECT b.text AS entity, d.doc_id::VARCHAR AS trace_id FROM (SELECT text, min(item_id % 2) AS split FROM benchmark GROUP BY text HAVING count(DISTINCT item_id % 2) = 1) b
JOIN documents d ON d.doc_id % 2 <> b.split AND contains(d.text, b.text)""")
def val_7_split_leaks(spark, d):
    b = at.table(spark, d, "benchmark").select(F.col("text").alias("entity"), F.when(F.col("item_id") % 2 == 0, "train").otherwise("test").alias("split"))
    blobs = at.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("trace_id"), F.when(F.col("doc_id") % 2 == 0, "train").otherwise("test").alias("split"), F.col("text").alias("blob"))
    return dataset.split_leaks(b, blobs)


@query(over("steps traces", f"""
, n AS (SELECT 1 AS g, CASE WHEN any_value(gt_outcome) = 'success' THEN 1 ELSE 0 END AS label, count(*)::DOUBLE AS score FROM steps JOIN traces USING (trace_id) WHERE gt_outcome <> 'unknown' GROUP BY trace_id)
SELECT n_pos, n_neg, round(auroc, 6) AS auroc FROM ({auroc_sql("n", "g", "score")})""").replace("\n\n, n AS", ", n AS"))  # fmt: skip
def val_7_step_count_auroc(spark, d):
    labels = at.traces(spark, d).where("gt_outcome != 'unknown'").select("trace_id", (F.col("gt_outcome") == "success").cast("int").alias("label"))
    return dataset.step_count_auroc(at.steps(spark, d), labels).select("n_pos", "n_neg", _r(F.col("auroc"), "auroc"))


def _made(spark, d) -> DataFrame:
    return generator.generate(spark, ids=at.table(spark, d, "customer").select(F.col("c_custkey").alias("id")))


@query()
def gen_2_plan(spark, d):
    """The design's cells over a trace for each customer."""
    return _made(spark, d).groupBy("domain", "split", "kind", "evidence", "label").agg(F.count("*").alias("n"))


@query()
def gen_5_outcomes(spark, d):
    """The rules on a trace for each customer, by kind."""
    from tracewright.sources.packs import builtin_packs

    made = _made(spark, d)
    traces, steps, claims = generator.as_tables(made)
    out = rules.worst_outcomes(rules.evaluate_claims(claims, steps, traces, builtin_packs()))
    return out.join(made.select("trace_id", "kind", "evidence"), "trace_id").groupBy("kind", "evidence", "outcome").agg(F.count("*").alias("n"))


@query()
def trn_4_leave_domain_out(spark, d):
    traces = at.traces(spark, d).where("gt_outcome != 'unknown'")
    rows = _features(spark, d).join(traces.select("trace_id", (F.col("gt_outcome") == "success").cast("int").alias("label")), "trace_id")
    return hypotheses.leave_domain_out(rows, step_ops.FEATURES, 0.1, ["booking", "crm", "coding"])
