"""The projections of plans/projection.py in DuckDB's SQL: common table expressions to put before a query."""

from __future__ import annotations

_STEPS = r"""
events_k AS (SELECT *, (props->>'$.k')::BIGINT AS k FROM events),
steps AS (
  SELECT 'u' || user_id AS trace_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INTEGER AS i,
    CASE event_type WHEN 'click' THEN 'tool_call' WHEN 'view' THEN 'tool_result' WHEN 'error' THEN 'tool_result' WHEN 'purchase' THEN 'state_probe' ELSE 'message' END AS kind,
    CASE event_type WHEN 'click' THEN 'agent' WHEN 'view' THEN 'tool' WHEN 'error' THEN 'tool' WHEN 'purchase' THEN 'environment' ELSE CASE WHEN k % 2 = 0 THEN 'user' ELSE 'agent' END END AS role,
    CASE WHEN event_type <> 'signup' THEN 'crm.' || (['create', 'update', 'get', 'search'])[k % 4 + 1] END AS name,
    k, 'r' || (k % 7) AS record_id, (['pending', 'confirmed', 'done', 'queued', 'open'])[k % 5 + 1] AS status, event_type,
    CASE event_type WHEN 'view' THEN true WHEN 'error' THEN false WHEN 'purchase' THEN k % 3 <> 0 END AS ok,
    event_type IN ('view', 'purchase') AS has_output, event_type = 'error' AS has_error
  FROM events_k)"""

_PAIRED = r"""
paired AS (
  SELECT *, CASE WHEN kind = 'tool_result' AND name IS NOT NULL THEN last_value(CASE WHEN kind = 'tool_call' THEN i END IGNORE NULLS) OVER (PARTITION BY trace_id, name ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS call_i
  FROM steps),
calls AS (
  SELECT c.trace_id, c.i AS call_i, c.name, r.i AS result_i, r.ok, r.has_output, r.has_error, r.k, r.record_id, r.status, c.k AS arg_k, c.record_id AS arg_record
  FROM (SELECT * FROM steps WHERE kind = 'tool_call') c
  LEFT JOIN (SELECT * FROM paired WHERE call_i IS NOT NULL QUALIFY row_number() OVER (PARTITION BY trace_id, call_i ORDER BY i DESC) = 1) r ON r.trace_id = c.trace_id AND r.call_i = c.i)"""

_TRACES = r"""
users AS (SELECT DISTINCT user_id AS n FROM events),
traces AS (
  SELECT 'u' || n AS trace_id, n AS line_no, (['booking', 'crm', 'coding'])[n % 3 + 1] AS domain, 'task ' || n AS task_id,
    'Set value ' || (n % 50) || ' on r' || (n % 7) || ' before 12:30' AS instruction,
    'Updated ' || (n % 10) || ' of ' || (n % 13) || ' records. ' || (['It looks like all is well.', 'Not yet updated the rest.', 'You can sign off on this.', 'I wasn''t able to finish.'])[n % 4 + 1] AS final_text,
    (['success', 'failure', 'success', 'unknown', 'failure'])[n % 5 + 1] AS gt_outcome
  FROM users)"""

_CLAIMS = r"""
claims AS (
  SELECT 'u' || n AS trace_id, 0 AS claim_idx, CASE WHEN n % 7 = 6 THEN 'failed' ELSE 'updated' END AS type, 'r' || (n % 7) AS s_record, NULL::BIGINT AS s_k FROM users WHERE n % 5 <> 4
  UNION ALL SELECT 'u' || n, 1, CASE WHEN n % 4 = 1 THEN 'unmapped' ELSE 'created' END, NULL, n % 10 FROM users WHERE n % 5 <> 4 AND n % 3 = 0)"""

_OUTCOMES = r"""
ruled AS (SELECT c.*, CASE WHEN (EXISTS (SELECT 1 FROM steps s WHERE s.trace_id = c.trace_id AND s.kind = 'tool_call')
    OR (NOT EXISTS (SELECT 1 FROM steps s WHERE s.trace_id = c.trace_id AND s.kind = 'tool_call') AND t.domain = 'crm')) AND c.type IN ('updated', 'created') THEN 'crm.' || c.type END AS rule
  FROM claims c JOIN traces t USING (trace_id)),
met AS (
  SELECT r.trace_id, r.claim_idx, r.rule, c.call_i, c.result_i, c.ok, c.has_error,
    CASE r.rule
      WHEN 'crm.updated' THEN coalesce(c.has_output AND c.record_id = r.s_record, false)
      ELSE coalesce(c.has_output AND c.k = r.s_k AND c.status IN ('pending', 'done'), false) END AS fits
  FROM ruled r JOIN calls c ON c.trace_id = r.trace_id AND ((r.rule = 'crm.updated' AND c.name = 'crm.update') OR (r.rule = 'crm.created' AND c.name = 'crm.create'))),
best AS (
  SELECT trace_id, claim_idx, count(*) AS n_calls,
    arg_max(result_i, call_i) FILTER (result_i IS NOT NULL AND ok AND NOT has_error AND fits) AS good,
    arg_max(result_i, call_i) FILTER (result_i IS NOT NULL AND (NOT ok OR has_error OR NOT fits)) AS bad
  FROM met GROUP BY ALL),
probe AS (SELECT * FROM steps WHERE kind = 'state_probe' AND name = 'crm.get' QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY i DESC) = 1),
outcomes AS (
  SELECT r.trace_id, r.claim_idx, r.type, r.rule,
    CASE WHEN r.rule IS NULL THEN 'unknown'
      WHEN b.good IS NOT NULL AND (p.i IS NULL OR r.rule = 'crm.created') THEN 'receipt_only'
      WHEN b.good IS NOT NULL AND (NOT p.ok OR p.status NOT IN ('confirmed', 'done')) THEN 'contradicted'
      WHEN b.good IS NOT NULL THEN 'probe_supported'
      WHEN b.bad IS NOT NULL THEN 'contradicted' ELSE 'unsupported' END AS outcome,
    CASE WHEN r.rule IS NULL THEN NULL
      WHEN b.good IS NOT NULL AND (p.i IS NULL OR r.rule = 'crm.created') THEN b.good
      WHEN b.good IS NOT NULL THEN p.i ELSE b.bad END AS step
  FROM ruled r LEFT JOIN best b USING (trace_id, claim_idx) LEFT JOIN probe p ON p.trace_id = r.trace_id),
worst AS (
  SELECT trace_id, arg_min(outcome, ord * 10 + claim_idx) AS outcome, min(ord) AS ord
  FROM (SELECT *, list_position(['contradicted', 'unsupported', 'unknown', 'receipt_only', 'probe_supported'], outcome) AS ord FROM outcomes) GROUP BY trace_id),
scored AS (SELECT trace_id, outcome, ([0.03, 0.05, NULL, 0.70, 0.97])[ord]::DOUBLE AS p, ord = 3 AS abstain FROM worst)"""

_PREDICTIONS = r"""
raw_predictions AS (
  SELECT l.doc_id, x.detector, 't' || l.doc_id AS trace_id, CASE WHEN l.doc_id % 5 < 3 THEN 'train' ELSE 'test' END AS split, d.lang AS domain,
    CASE WHEN l.toxic = 1 THEN 'wrong_value' ELSE 'wrong_target' END AS kind, CASE WHEN l.doc_id % 2 = 0 THEN 'state_probe' ELSE 'receipt_only' END AS evidence, l.quality AS label, x.p AS p,
    l.doc_id % 17 = 0 AS abstain, (l.doc_id % 1000) / 10.0::DOUBLE AS latency_ms, (l.doc_id % 13) / 1e5::DOUBLE AS cost_usd, l.doc_id % 4 = 0 AS cached
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id,
    LATERAL (SELECT 'a' AS detector, ((l.doc_id * 7919) % 1000) / 1000.0::DOUBLE AS p UNION ALL SELECT 'b', ((l.doc_id * 104729) % 100) / 100.0::DOUBLE * 0.5::DOUBLE + l.quality * 0.4::DOUBLE) x
  WHERE l.quality IS NOT NULL),
predictions AS (SELECT *, CASE WHEN abstain THEN 'unverifiable' WHEN p >= 0.8::DOUBLE THEN 'verified' WHEN p <= 0.2::DOUBLE THEN 'false_success' ELSE 'unverifiable' END AS verdict FROM raw_predictions)"""

_PARTS = {"steps": _STEPS, "paired": _PAIRED, "traces": _TRACES, "claims": _CLAIMS, "outcomes": _OUTCOMES, "predictions": _PREDICTIONS}


def over(parts: str, query: str) -> str:
    """A query over the named projections."""
    return "WITH " + ",".join(_PARTS[p].strip() for p in parts.split()) + "\n" + query


#: The AUROC of rows (by, label, score) by counting pairs of a success and a failure: each pair once, ties half.
def auroc_sql(source: str, by: str, score: str) -> str:
    return f"""
      SELECT {by}, n_pos, n_neg, CASE WHEN n_pos > 0 AND n_neg > 0 THEN (rank_sum - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg) END AS auroc FROM (
        SELECT {by}, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg, sum(rk) FILTER (label = 1) AS rank_sum FROM (
          SELECT *, rank() OVER (PARTITION BY {by} ORDER BY {score}) + (count(*) OVER (PARTITION BY {by}, {score}) - 1) / 2.0 AS rk FROM {source}) GROUP BY {by})"""
