"""SQL of the registered queries that SQL can express."""

_LABEL = "nullif(replace(replace(lower(regexp_replace({0}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')), ' ', '_'), '-', '_'), '')"
_KEY = "nullif(lower(regexp_replace({0}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')), '')"

_QUOTAS = f"""
have AS (
  SELECT {_LABEL.format('stratum')} AS s, count(DISTINCT {_KEY.format('case_id')}) AS n FROM wikitq_cases GROUP BY 1
), q AS (
  SELECT q.plan_id, q.stratum, q.quota, q.min_rows, p.requested_size AS size, coalesce(have.n, 0) AS available,
    greatest(q.min_rows, CAST(floor(p.requested_size * q.quota / sum(q.quota) OVER (PARTITION BY q.plan_id)) AS BIGINT)) AS required
  FROM sampling_quotas q JOIN sampling_plans p ON p.plan_id = q.plan_id LEFT JOIN have ON have.s = {_LABEL.format('q.stratum')}
)"""
_KEYS = f"""
keys AS (
  SELECT k AS case_id, min(b) AS first_batch, CAST('0x' || substr(md5(k), 1, 8) AS BIGINT) % 65536 AS bucket
  FROM (SELECT {_KEY.format('case_id')} AS k, CAST(coalesce(batch_no, 9223372036854775807) AS BIGINT) AS b FROM wikitq_cases) WHERE k IS NOT NULL GROUP BY k
), permuted AS (
  SELECT plan_id, seed, requested_size AS size, bucket, row_number() OVER (PARTITION BY plan_id ORDER BY md5(seed || ':' || bucket), bucket) AS position
  FROM sampling_plans, (SELECT unnest(range(65536)) AS bucket)
)"""
# the lists that hold the requested size of the keys for which the condition is true
_LISTED = """
SELECT plan_id, bucket, position FROM (
  SELECT p.plan_id, p.bucket, p.position, p.size, sum(coalesce(h.held, 0)) OVER (PARTITION BY p.plan_id ORDER BY p.position) - coalesce(h.held, 0) AS before
  FROM permuted p LEFT JOIN (SELECT bucket, count(*) AS held FROM keys WHERE {0} GROUP BY bucket) h ON h.bucket = p.bucket
) WHERE before < size"""

_SHARED = """
WITH i AS (
  SELECT item_id, regexp_extract_all(lower(item_text), '[\\p{L}\\p{N}]+') AS w FROM heldout_items
), i2 AS (
  SELECT item_id, w, CASE WHEN len(w) >= 12 THEN 12 ELSE len(w) END AS n FROM i WHERE len(w) >= 8
), ig AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS g
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM i2)
), d AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents
), dg AS (
  SELECT doc_id, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT unnest([8, 9, 10, 11, 12]) AS n) WHERE len(w) >= n)
)
SELECT DISTINCT dg.doc_id, ig.item_id FROM dg JOIN ig ON ig.n = dg.n AND ig.g = dg.g"""

_PLANNED = f"""
WITH size AS (
  SELECT {_LABEL.format('source')} AS s, sum(len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s\\p{{Z}}]+'))) AS tokens FROM documents GROUP BY 1
), t AS (
  SELECT *, sum(weight) OVER (PARTITION BY mixture_id) AS total FROM mixture_targets
), r AS (
  SELECT t.mixture_id, t.source, CAST(coalesce(size.tokens, 0) AS BIGINT) AS size_tokens, t.weight / t.total * t.budget_tokens AS wanted,
    CAST(t.max_repeats * coalesce(size.tokens, 0) AS BIGINT) AS most_tokens
  FROM t LEFT JOIN size ON size.s = {_LABEL.format('t.source')}
)
SELECT mixture_id, source, size_tokens, round(wanted, 6) AS wanted_tokens, most_tokens,
  least(CAST(floor(wanted + 0.5) AS BIGINT), most_tokens) AS allotted_tokens, most_tokens < wanted AS short
FROM r"""
# each document has one source, so a source takes the beginning of its documents' order
_SELECTED = f"""
docs AS (
  SELECT doc_id, {_LABEL.format('source')} AS source, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s\\p{{Z}}]+')) AS tokens FROM documents
), placed AS (
  SELECT doc_id, source, tokens, sum(tokens) OVER (PARTITION BY source ORDER BY md5('20260619:' || doc_id), doc_id) - tokens / 2.0 AS middle, sum(tokens) OVER (PARTITION BY source) AS size FROM docs WHERE tokens > 0
), planned AS ({_PLANNED}), chosen AS (
  SELECT p.mixture_id, d.source, d.doc_id, CAST(d.tokens AS BIGINT) AS tokens, CAST(p.allotted_tokens // d.size + CASE WHEN d.middle < p.allotted_tokens % d.size THEN 1 ELSE 0 END AS BIGINT) AS repeats
  FROM placed d JOIN planned p ON d.source = {_LABEL.format('p.source')} WHERE p.allotted_tokens // d.size + CASE WHEN d.middle < p.allotted_tokens % d.size THEN 1 ELSE 0 END > 0
)"""

ORACLES: dict[str, str] = {
    "p1_quotas": f"WITH {_QUOTAS} SELECT DISTINCT plan_id, stratum, required, available FROM q",
    # strata share no case in these tables, so only minimum rows and what is there bind
    "p1_totals": f"""
WITH {_QUOTAS}, t AS (
  SELECT plan_id, max(size) AS size, sum(least(min_rows, available)) AS lower, sum(CASE WHEN quota > 0 THEN available ELSE least(min_rows, available) END) AS most FROM q GROUP BY plan_id
)
SELECT plan_id, CAST(greatest(lower, least(size, most)) AS BIGINT) AS cases, CAST(greatest(lower, least(size, most)) AS BIGINT) AS rows FROM t WHERE greatest(lower, least(size, most)) > 0""",
    "p2_stable_sample": f"""
WITH {_KEYS}, lists AS ({_LISTED.format('first_batch = (SELECT min(first_batch) FROM keys)')})
SELECT l.plan_id, k.case_id, CASE WHEN k.first_batch < 9223372036854775807 THEN k.first_batch END AS first_batch, l.position FROM keys k JOIN lists l ON l.bucket = k.bucket""",
    "p2_kept_lists": f"""
WITH {_KEYS}, lists AS ({_LISTED.format('first_batch <= 4')})
SELECT l.plan_id, k.case_id, CASE WHEN k.first_batch < 9223372036854775807 THEN k.first_batch END AS first_batch, l.position, k.first_batch <= 4 AS opening FROM keys k JOIN lists l ON l.bucket = k.bucket""",
    "p1_found": f"""
WITH have AS (
  SELECT {_LABEL.format('stratum')} AS s, count(DISTINCT {_KEY.format('case_id')}) AS n FROM wikitq_cases GROUP BY 1
), q AS (
  SELECT plan_id, stratum, quota, min_rows, sum(quota) OVER (PARTITION BY plan_id) AS total FROM sampling_quotas
)
SELECT DISTINCT q.plan_id, q.stratum
FROM q JOIN sampling_plans p ON p.plan_id = q.plan_id LEFT JOIN have ON have.s = {_LABEL.format('q.stratum')}
WHERE coalesce(have.n, 0) < greatest(q.min_rows, CAST(floor(p.requested_size * q.quota / q.total) AS BIGINT))""",
    "p3_found": """
SELECT DISTINCT s.state_id,
  CASE WHEN list_max(list_transform(string_split_regex(s.chunk_text, '[\\s\\p{Z}.!?。！？]'), lambda x: length(x))) > p.max_chunk_size THEN 'hard' ELSE 'soft' END AS cut
FROM sandbox_states s JOIN chunk_policies p ON p.policy_id = s.policy_id
WHERE length(s.chunk_text) > p.max_chunk_size""",
    "p6_found": _SHARED,
    "p6_items": f"SELECT item_id, count(*) AS documents FROM ({_SHARED}) GROUP BY item_id",
    "p7_found": f"""
WITH size AS (
  SELECT {_LABEL.format('source')} AS s, sum(len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s\\p{{Z}}]+'))) AS tokens FROM documents GROUP BY 1
), t AS (
  SELECT *, sum(weight) OVER (PARTITION BY mixture_id) AS total FROM mixture_targets
)
SELECT DISTINCT t.mixture_id, t.source
FROM t LEFT JOIN size ON size.s = {_LABEL.format('t.source')}
WHERE t.max_repeats * coalesce(size.tokens, 0) < t.weight / t.total * t.budget_tokens""",
    "p7_plan": _PLANNED,
    "p7_selection": f"WITH {_SELECTED} SELECT mixture_id, source, doc_id, tokens, repeats FROM chosen",
    "p7_shares": f"""
WITH {_SELECTED}, got AS (SELECT mixture_id, source, CAST(sum(tokens * repeats) AS BIGINT) AS tokens, count(*) AS records FROM chosen GROUP BY ALL),
w AS (SELECT mixture_id, {_LABEL.format('source')} AS source, weight / sum(weight) OVER (PARTITION BY mixture_id) AS target_share FROM mixture_targets),
j AS (SELECT w.mixture_id, w.source, w.target_share, coalesce(got.tokens, 0) AS tokens, coalesce(got.records, 0) AS records FROM w LEFT JOIN got ON got.mixture_id = w.mixture_id AND got.source = w.source)
SELECT *, CASE WHEN sum(tokens) OVER (PARTITION BY mixture_id) > 0 THEN tokens / sum(tokens) OVER (PARTITION BY mixture_id) ELSE 0.0 END AS share FROM j""",
}
