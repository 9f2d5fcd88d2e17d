"""DuckDB SQL for every registered query: the independent check the driver
runs at sf0.01. Each string defines the stand-in views as CTEs over the
pre-registered tables and states the operator by its definition (brute force
where that is the clearest statement), never by calling this library."""

from __future__ import annotations

# --- stand-in views (DuckDB dialect) -----------------------------------------

TXN = """txn AS (
  SELECT event_id AS txn_id, user_id AS card_id, CAST(ts AS TIMESTAMP) AS ts,
         epoch_us(ts) // 1000000 AS ts_sec, value AS amt,
         'merchant_' || json_extract_string(props, '$.k') AS merchant,
         event_type AS category, CAST(event_type = 'error' AS INTEGER) AS is_fraud,
         hour(ts) AS hour_of_day, isodow(ts) - 1 AS day_of_week
  FROM events)"""

TXN_TIES = """txn_ties AS (
  SELECT o_orderkey AS txn_id, o_custkey AS card_id, CAST(o_orderdate AS TIMESTAMP) AS ts,
         epoch_us(o_orderdate) // 1000000 AS ts_sec, o_totalprice AS amt,
         CAST(o_orderstatus = 'P' AS INTEGER) AS is_fraud,
         hour(o_orderdate) AS hour_of_day, isodow(o_orderdate) - 1 AS day_of_week
  FROM orders)"""


def causal_cte(src: str, name: str = "feat") -> str:
    """Causal features by their definition: a per-card self-join on earlier
    rows in (ts_sec, txn_id) order."""
    return f"""{name}_prev AS (
  SELECT a.txn_id,
         count(b.txn_id) FILTER (WHERE a.ts_sec - b.ts_sec <= 3600) AS v1,
         count(b.txn_id) FILTER (WHERE a.ts_sec - b.ts_sec <= 86400) AS v24,
         count(b.txn_id) AS n_prev, avg(b.amt) AS mu, stddev_pop(b.amt) AS sd,
         min(b.ts_sec) AS first_prev
  FROM {src} a LEFT JOIN {src} b
    ON a.card_id = b.card_id
   AND (b.ts_sec < a.ts_sec OR (b.ts_sec = a.ts_sec AND b.txn_id < a.txn_id))
  GROUP BY a.txn_id),
{name} AS (
  SELECT s.*, p.v1 AS velocity_1h, p.v24 AS velocity_24h,
         CASE WHEN p.n_prev >= 2 THEN (s.amt - p.mu) / (p.sd + 1e-6) ELSE 0.0 END AS amt_zscore,
         CASE WHEN p.first_prev IS NULL THEN 0.0
              ELSE (s.ts_sec - p.first_prev) / 86400.0 END AS card_tenure_days
  FROM {src} s JOIN {name}_prev p USING (txn_id))"""


def split_cte(src: str, name: str = "split", train: float = 0.8, keep: float = 0.9) -> str:
    return f"""{name} AS (
  SELECT *, CASE WHEN _rn < floor(_n * CAST({train!r} AS DOUBLE)) THEN 'train'
                 WHEN _rn < floor(_n * CAST({keep!r} AS DOUBLE)) THEN 'val'
                 ELSE 'test' END AS train_split
  FROM (SELECT *, row_number() OVER (ORDER BY ts_sec, txn_id) - 1 AS _rn,
               count(*) OVER () AS _n FROM {src}))"""


ORACLES: dict[str, str] = {}

ORACLES["causal_features"] = f"""
WITH {TXN}, {causal_cte('txn')}
SELECT txn_id, card_id, ts_sec, velocity_1h, velocity_24h,
       round(amt_zscore, 6) AS amt_zscore, card_tenure_days
FROM feat"""

ORACLES["causal_features_skew"] = f"""
WITH {TXN_TIES}, {causal_cte('txn_ties')}
SELECT txn_id, card_id, ts_sec, velocity_1h, velocity_24h,
       round(amt_zscore, 6) AS amt_zscore, card_tenure_days
FROM feat"""

ORACLES["time_split"] = f"""
WITH {TXN}, {split_cte('txn')}
SELECT txn_id, ts_sec, train_split FROM split"""

ORACLES["split_report"] = f"""
WITH {TXN}, {causal_cte('txn')}, {split_cte('feat')}
SELECT train_split, count(*) AS n, CAST(sum(is_fraud) AS BIGINT) AS n_fraud,
       round(100.0 * sum(is_fraud) / count(*), 6) AS pct_fraud,
       round(avg(velocity_1h), 6) AS mean_velocity_1h,
       round(avg(velocity_24h), 6) AS mean_velocity_24h,
       round(avg(greatest(least(amt_zscore, 10.0), -10.0)), 6) AS mean_amt_zscore_clipped,
       round(max(card_tenure_days), 6) AS max_card_tenure_days
FROM split GROUP BY train_split"""

# --- more stand-in views ----------------------------------------------------

ECOM = """ecom AS (
  SELECT o.o_orderkey AS txn_id, o.o_custkey AS card_id, CAST(o.o_orderdate AS TIMESTAMP) AS ts,
         epoch_us(o.o_orderdate) // 1000000 AS ts_sec, o.o_totalprice AS TransactionAmt,
         substr(o.o_orderpriority, 3, 1) AS ProductCD, lower(c.c_mktsegment) AS card4,
         CASE o.o_orderstatus WHEN 'F' THEN 'debit' WHEN 'O' THEN 'credit' END AS card6,
         CASE o.o_custkey % 6 WHEN 0 THEN 'gmail.com' WHEN 1 THEN 'ProtonMail.com'
              WHEN 2 THEN 'acme.com' WHEN 4 THEN 'yahoo.fr' WHEN 5 THEN 'Hotmail.com' END AS P_emaildomain,
         CASE o.o_orderkey % 4 WHEN 0 THEN 'gmail.com' WHEN 2 THEN 'acme.com'
              WHEN 3 THEN 'cuvox.de' END AS R_emaildomain,
         CASE o.o_orderkey % 3 WHEN 0 THEN 'desktop' WHEN 1 THEN 'mobile' END AS DeviceType,
         CASE o.o_orderkey % 5 WHEN 0 THEN 'iOS' WHEN 1 THEN 'Windows' WHEN 2 THEN 'missing' END AS DeviceInfo,
         CAST(c.c_acctbal AS DOUBLE) AS dist1, CAST(c.c_nationkey AS DOUBLE) AS addr1,
         CAST(n.n_regionkey AS DOUBLE) AS addr2,
         CAST(o.o_orderstatus = 'P' AS INTEGER) AS is_fraud,
         hour(o.o_orderdate) AS hour_of_day, isodow(o.o_orderdate) - 1 AS day_of_week
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
       LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey)"""

GEO = """geo AS (
  SELECT *, 25.25 + CAST((card_id * 7) % 23 AS DOUBLE) AS lat,
         -119.5 + CAST((card_id * 11) % 50 AS DOUBLE) AS long,
         25.25 + CAST((card_id * 7) % 23 AS DOUBLE) + CAST(txn_id % 21 - 10 AS DOUBLE) / 4.0 AS merch_lat,
         -119.5 + CAST((card_id * 11) % 50 AS DOUBLE) + CAST((txn_id * 3) % 41 - 20 AS DOUBLE) / 2.0 AS merch_long,
         DATE '1950-01-01' + CAST((card_id * 97) % 18000 AS INTEGER) AS dob
  FROM feat)"""

ACT = """act AS (
  SELECT vec_id AS row_idx, embedding AS activation_vector,
         ((vec_id * 37) % 101) / 100.0 AS fraud_score,
         CAST(label = 0 AS INTEGER) AS label, label AS class_id
  FROM embeddings)"""

ANON_SQL = ("('protonmail.com','guerrillamail.com','yopmail.com','dispostable.com','mailnull.com',"
            "'sharklasers.com','trashmail.com','tempr.email','cuvox.de','anonaddy.com',"
            "'tutanota.com','cock.li')")
FREE_SQL = ("('gmail.com','yahoo.com','hotmail.com','outlook.com','aol.com','live.com','icloud.com',"
            "'me.com','msn.com','comcast.net','yahoo.fr','yahoo.co.uk','yahoo.de','yahoo.es',"
            "'yahoo.co.jp','hotmail.co.uk','hotmail.fr','hotmail.de','att.net','verizon.net',"
            "'sbcglobal.net','frontier.com')")


def email_group_sql(col: str) -> str:
    return (f"CASE WHEN {col} IS NULL THEN 'missing' WHEN lower({col}) IN {ANON_SQL} THEN 'anonymous' "
            f"WHEN lower({col}) IN {FREE_SQL} THEN 'free' ELSE 'corporate' END")


ORACLES["ecom_features"] = f"""
WITH {ECOM}
SELECT txn_id, card_id, ts_sec, hour_of_day, day_of_week, TransactionAmt,
       {email_group_sql('P_emaildomain')} AS p_email_group,
       {email_group_sql('R_emaildomain')} AS r_email_group,
       CAST(CASE WHEN P_emaildomain IS NULL OR R_emaildomain IS NULL THEN -1.0
            WHEN P_emaildomain = R_emaildomain THEN 1.0 ELSE 0.0 END AS DOUBLE) AS email_match,
       'ieee-fraud-detection' AS dataset_source, is_fraud
FROM ecom"""

ORACLES["offset_timestamps"] = """
SELECT o_orderkey AS txn_id,
       epoch_us(TIMESTAMP '2017-11-30 00:00:00' + to_seconds(o_orderkey * 3607)) // 1000000 AS ts_sec,
       hour(TIMESTAMP '2017-11-30 00:00:00' + to_seconds(o_orderkey * 3607)) AS hour_of_day,
       isodow(TIMESTAMP '2017-11-30 00:00:00' + to_seconds(o_orderkey * 3607)) - 1 AS day_of_week
FROM orders"""

ORACLES["card_present_features"] = f"""
WITH {TXN}, {causal_cte('txn')}, {GEO}
SELECT txn_id,
       round(2 * 6371.0 * asin(sqrt(least(
         pow(sin((radians(merch_lat) - radians(lat)) / 2), 2)
         + cos(radians(lat)) * cos(radians(merch_lat))
           * pow(sin((radians(merch_long) - radians(long)) / 2), 2), 1.0))), 6) AS geo_distance_km,
       date_diff('day', dob, CAST(ts AS DATE)) / 365.25 AS age_at_txn,
       round(greatest(least(amt_zscore, 10.0), -10.0), 6) AS amt_zscore_clipped,
       CAST(least(velocity_1h, 200) AS DOUBLE) AS velocity_1h_clipped,
       round(1.0 / (1.0 + exp(-(amt / 50.0 - 1.0))), 6) AS amt_logistic
FROM geo"""


def score_bin_sql(col: str) -> str:
    return (f"(CAST({col} >= 0.2 AS INTEGER) + CAST({col} >= 0.4 AS INTEGER) "
            f"+ CAST({col} >= 0.6000000000000001 AS INTEGER) + CAST({col} >= 0.8 AS INTEGER))")


ORACLES["score_bins"] = f"""
WITH {ACT}
SELECT row_idx, fraud_score, label, {score_bin_sql('fraud_score')} AS score_bin,
       CAST(label AS VARCHAR) || '|' || CAST({score_bin_sql('fraud_score')} AS VARCHAR) AS cell
FROM act"""

ORACLES["text_checks"] = """
SELECT doc_id,
       length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 0 AS non_blank,
       (length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) = 0
        OR substr(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 1, 1) IN ('-', '•', '*')) AS bullet_ok,
       (text IS NULL OR lower(trim(text)) IN ('nan', 'none', 'missing', '__missing__', '')) AS is_missing,
       lang
FROM documents"""

# --- rendering ------------------------------------------------------------------

MISSING_SQL = "('nan', 'none', 'missing', '__missing__', '')"


def present_s(c: str) -> str:
    return f"({c} IS NOT NULL AND lower(trim({c})) NOT IN {MISSING_SQL})"


def present_d(c: str) -> str:
    return f"({c} IS NOT NULL AND NOT isnan({c}))"


def hour_label_sql(h: str) -> str:
    hh = f"(CAST(round_even(CAST({h} AS DOUBLE), 0) AS BIGINT) % 24)"
    return (f"lpad(CAST({hh} AS VARCHAR), 2, '0') || ':xx (' || CASE WHEN {hh} < 6 THEN 'overnight' "
            f"WHEN {hh} < 12 THEN 'morning' WHEN {hh} < 18 THEN 'afternoon' ELSE 'evening' END || ')'")


def day_name_sql(d: str) -> str:
    return ("['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday']"
            f"[CAST(round_even(CAST({d} AS DOUBLE), 0) AS BIGINT) % 7 + 1]")


def time_part_sql() -> str:
    inner = (f"concat_ws(', ', CASE WHEN {present_d('hour_of_day')} THEN {hour_label_sql('hour_of_day')} END, "
             f"CASE WHEN {present_d('day_of_week')} THEN {day_name_sql('day_of_week')} END)")
    return f"CASE WHEN {inner} <> '' THEN 'Time: ' || {inner} END"


def z_label_sql(z: str) -> str:
    return (f"printf('z=%+.1f (%s)', {z}, CASE WHEN {z} > 4 THEN 'extremely high' WHEN {z} > 2 THEN 'high' "
            f"WHEN {z} > 0.5 THEN 'above average' WHEN {z} < -2 THEN 'very low' "
            f"WHEN {z} < -0.5 THEN 'below average' ELSE 'typical' END)")


def tail_sql(tenure: str) -> str:
    return ", ".join([
        f"CASE WHEN {present_d('velocity_1h')} THEN printf('Card velocity: %d txn in past 1h', "
        f"CAST(round_even(CAST(velocity_1h AS DOUBLE), 0) AS BIGINT)) END",
        f"CASE WHEN {present_d('velocity_24h')} THEN printf('Card velocity: %d txn in past 24h', "
        f"CAST(round_even(CAST(velocity_24h AS DOUBLE), 0) AS BIGINT)) END",
        f"CASE WHEN {present_d('amt_zscore')} THEN 'Amount vs card history: ' || {z_label_sql('amt_zscore')} END",
        f"CASE WHEN {present_d('card_tenure_days')} THEN {tenure} END",
        f"CASE WHEN {present_d('fraud_score')} THEN printf('Model fraud score: %.3f', fraud_score) END",
    ])


TENURE_CP = ("CASE WHEN card_tenure_days < 1 THEN 'Card tenure: new card' "
             "WHEN card_tenure_days < 30 THEN printf('Card tenure: %.0f days', card_tenure_days) "
             "ELSE printf('Card tenure: %.0f days (%.1f months)', card_tenure_days, card_tenure_days / 30) END")
TENURE_EC = ("CASE WHEN card_tenure_days < 1 THEN 'Card tenure: new card (first seen today)' "
             "WHEN card_tenure_days < 7 THEN printf('Card tenure: %.0f day(s)', card_tenure_days) "
             "WHEN card_tenure_days < 30 THEN printf('Card tenure: %.0f days (%.1f weeks)', card_tenure_days, card_tenure_days / 7) "
             "ELSE printf('Card tenure: %.0f days (%.1f months)', card_tenure_days, card_tenure_days / 30) END")

CAT_MAP_SQL = ("MAP {'gas_transport': 'gas station / transport', 'grocery_pos': 'grocery store (in-person)', "
               "'grocery_net': 'grocery store (online)', 'home': 'home goods', 'entertainment': 'entertainment', "
               "'food_dining': 'food & dining', 'personal_care': 'personal care', "
               "'health_fitness': 'health & fitness', 'shopping_pos': 'retail shopping (in-person)', "
               "'shopping_net': 'retail shopping (online)', 'misc_pos': 'misc retail (in-person)', "
               "'misc_net': 'misc retail (online)', 'travel': 'travel', 'kids_pets': 'kids & pets'}")

CP_CATEGORY = """CASE pmod_cat WHEN 0 THEN 'misc_net' WHEN 1 THEN 'grocery_pos' WHEN 2 THEN 'travel'
                 WHEN 3 THEN 'kids_pets' WHEN 4 THEN 'gas_transport' ELSE category END"""

RENDER_CP_SQL = f"""concat_ws('; ',
    CASE WHEN {present_s('merchant')} THEN 'Merchant: ' || merchant ||
           CASE WHEN {present_s('category')} THEN ' (' || coalesce({CAT_MAP_SQL}[category], category) || ')' ELSE '' END
         WHEN {present_s('category')} THEN 'Category: ' || coalesce({CAT_MAP_SQL}[category], category) END,
    CASE WHEN {present_d('amt')} THEN printf('Amount: $%.2f', amt) END,
    {time_part_sql()},
    CASE WHEN {present_d('age_at_txn')} THEN printf('Cardholder age: %.0f years', age_at_txn) END,
    CASE WHEN {present_d('geo_distance_km')} THEN printf('Distance home→merchant: %.1f km (%s)', geo_distance_km,
         CASE WHEN geo_distance_km < 5 THEN 'local' WHEN geo_distance_km < 50 THEN 'nearby'
              WHEN geo_distance_km < 500 THEN 'regional' ELSE 'far/unusual' END) END,
    {tail_sql(TENURE_CP)}) || '.'"""

ORACLES["render_card_present"] = f"""
WITH {TXN}, {causal_cte('txn')}, {GEO},
cp AS (
  SELECT txn_id, CASE WHEN txn_id % 7 = 3 THEN NULL ELSE merchant END AS merchant,
         {CP_CATEGORY.replace('pmod_cat', '(txn_id % 9)')} AS category,
         amt, hour_of_day, day_of_week, velocity_1h, velocity_24h, amt_zscore, card_tenure_days,
         2 * 6371.0 * asin(sqrt(least(
           pow(sin((radians(merch_lat) - radians(lat)) / 2), 2)
           + cos(radians(lat)) * cos(radians(merch_lat))
             * pow(sin((radians(merch_long) - radians(long)) / 2), 2), 1.0))) AS geo_distance_km,
         date_diff('day', dob, CAST(ts AS DATE)) / 365.25 AS age_at_txn,
         ((txn_id * 37) % 101) / 100.0 AS fraud_score
  FROM geo)
SELECT txn_id, {RENDER_CP_SQL} AS rendered FROM cp"""

PROD_MAP_SQL = ("MAP {'W': 'web purchase', 'H': 'hotel/lodging', 'C': 'card-present', "
                "'S': 'service/subscription', 'R': 'retail purchase'}")

RENDER_EC_SQL = f"""concat_ws('; ',
    CASE WHEN {present_s('ProductCD')} THEN 'Transaction type: ' ||
         coalesce({PROD_MAP_SQL}[upper(ProductCD)], 'product code ' || ProductCD) END,
    CASE WHEN {present_d('TransactionAmt')} THEN printf('Amount: $%.2f', TransactionAmt) END,
    {time_part_sql()},
    CASE WHEN concat_ws(' ', CASE WHEN {present_s('card4')} THEN card4 END,
                             CASE WHEN {present_s('card6')} THEN card6 END) <> ''
         THEN 'Card: ' || concat_ws(' ', CASE WHEN {present_s('card4')} THEN card4 END,
                                         CASE WHEN {present_s('card6')} THEN card6 END) END,
    CASE WHEN {present_s('P_emaildomain')} THEN 'Purchaser email: ' || P_emaildomain ||
           CASE WHEN {present_s('p_email_group')} THEN ' [' || p_email_group || ']' ELSE '' END ||
           CASE WHEN lower(P_emaildomain) IN {ANON_SQL} THEN ' (privacy/anonymous)' ELSE '' END
         WHEN {present_s('p_email_group')} THEN 'Purchaser email: missing (group=' || p_email_group || ')' END,
    CASE WHEN {present_s('R_emaildomain')} AND R_emaildomain IS DISTINCT FROM P_emaildomain
         THEN 'Recipient email: ' || R_emaildomain END,
    CASE WHEN {present_d('email_match')} AND email_match = 1.0 THEN 'Email match: purchaser and recipient domains match'
         WHEN {present_d('email_match')} AND email_match = 0.0 THEN 'Email match: purchaser and recipient domains differ' END,
    CASE WHEN concat_ws(' ', CASE WHEN {present_s('DeviceType')} THEN DeviceType END,
                             CASE WHEN {present_s('DeviceInfo')} AND DeviceInfo NOT IN ('missing', '__missing__')
                                  THEN '(' || DeviceInfo || ')' END) <> ''
         THEN 'Device: ' || concat_ws(' ', CASE WHEN {present_s('DeviceType')} THEN DeviceType END,
                             CASE WHEN {present_s('DeviceInfo')} AND DeviceInfo NOT IN ('missing', '__missing__')
                                  THEN '(' || DeviceInfo || ')' END) END,
    CASE WHEN geo_inner <> '' THEN 'Geography: ' || geo_inner END,
    {tail_sql(TENURE_EC)}) || '.'"""

ORACLES["render_ecom"] = f"""
WITH {ECOM.replace('ecom AS', 'ecom0 AS')},
ecom AS (SELECT txn_id, card_id, ts_sec, TransactionAmt AS amt, * EXCLUDE (txn_id, card_id, ts_sec) FROM ecom0),
{causal_cte('ecom')},
e2 AS (
  SELECT *, {email_group_sql('P_emaildomain')} AS p_email_group,
         CAST(CASE WHEN P_emaildomain IS NULL OR R_emaildomain IS NULL THEN -1.0
              WHEN P_emaildomain = R_emaildomain THEN 1.0 ELSE 0.0 END AS DOUBLE) AS email_match,
         concat_ws(', ',
           CASE WHEN {present_d('addr2')} THEN CASE WHEN addr2 >= 0
                THEN 'country code ' || CAST(CAST(trunc(addr2) AS BIGINT) AS VARCHAR)
                ELSE CAST(addr2 AS VARCHAR) END END,
           CASE WHEN {present_d('addr1')} THEN 'billing zip prefix ' || CAST(CAST(trunc(addr1) AS BIGINT) AS VARCHAR) END,
           CASE WHEN {present_d('dist1')} AND dist1 > 0 THEN printf('address–card distance %.0f mi', dist1) END) AS geo_inner,
         CAST(NULL AS DOUBLE) AS fraud_score
  FROM feat)
SELECT txn_id, {RENDER_EC_SQL} AS rendered FROM e2"""

# --- vectors and metrics -----------------------------------------------------------

RECON = """recon AS (
  SELECT a.row_idx, CAST(a.activation_vector AS DOUBLE[]) AS g,
         list_transform(range(1, len(a.activation_vector) + 1),
           lambda i: 0.8 * CAST(a.activation_vector[i] AS DOUBLE)
                   + 0.2 * CAST(coalesce(b.activation_vector, a.activation_vector)[i] AS DOUBLE)) AS p,
         a.fraud_score, a.label
  FROM act a LEFT JOIN act b ON b.row_idx = a.row_idx + 1)"""


def _norm(v: str) -> str:
    return f"sqrt(list_sum(list_transform({v}, lambda x: x * x)))"


def _to_metric(v: str, d: str) -> str:
    return f"list_transform({v}, lambda x: x / ({_norm(v)} + 1e-8) * sqrt({d}))"


NRM = f"""nrm AS (
  SELECT row_idx, label, fraud_score, len(g) AS d,
         {_to_metric('g', 'len(g)')} AS gn, {_to_metric('p', 'len(g)')} AS pn,
         list_sum(list_transform(range(1, len(g) + 1), lambda i: g[i] * p[i]))
           / greatest({_norm('g')} * {_norm('p')}, 1e-8) AS cos
  FROM recon)"""

ROWMSE = """rowmse AS (
  SELECT *, list_sum(list_transform(range(1, d + 1), lambda i: (pn[i] - gn[i]) * (pn[i] - gn[i]))) / d AS mse
  FROM nrm)"""


def fve_sql(group: str | None) -> str:
    """FVE by its two-pass definition: mean over rows and dims of the squared
    error over the same for the deviation from the per-dim mean."""
    g = group or "'all'"
    return f"""dims AS (
  SELECT {g} AS slice, row_idx, unnest(range(1, d + 1)) AS i, unnest(gn) AS gv, unnest(pn) AS pv FROM nrm),
mu AS (SELECT slice, i, avg(gv) AS m FROM dims GROUP BY slice, i),
agg AS (
  SELECT d.slice, count(DISTINCT d.row_idx) AS n, avg((d.pv - d.gv) * (d.pv - d.gv)) AS num,
         avg((d.gv - mu.m) * (d.gv - mu.m)) AS den
  FROM dims d JOIN mu ON d.slice = mu.slice AND d.i = mu.i GROUP BY d.slice)"""


ORACLES["vector_norms"] = f"""
WITH {ACT}
SELECT row_idx, round({_norm('CAST(activation_vector AS DOUBLE[])')}, 6) AS l2_norm,
       list_transform(CAST(activation_vector AS DOUBLE[]),
         lambda x: round(x / greatest({_norm('CAST(activation_vector AS DOUBLE[])')}, 1e-8), 6)) AS activation_vector_normed
FROM act"""

ORACLES["vector_mean"] = f"""
WITH {ACT},
dims AS (SELECT class_id, unnest(range(1, len(activation_vector) + 1)) AS i,
                unnest(CAST(activation_vector AS DOUBLE[])) AS v FROM act),
m AS (SELECT class_id, i, avg(v) AS mv FROM dims GROUP BY class_id, i),
c AS (SELECT class_id, count(*) AS n FROM act GROUP BY class_id)
SELECT m.class_id, c.n, list(round(mv, 6) ORDER BY i) AS mean_vector
FROM m JOIN c USING (class_id) GROUP BY m.class_id, c.n"""

ORACLES["fve_by_label"] = f"""
WITH {ACT}, {RECON}, {NRM}, {ROWMSE},
nrm2 AS (SELECT * REPLACE (CAST(label AS VARCHAR) AS label) FROM nrm
         UNION ALL SELECT * REPLACE ('all' AS label) FROM nrm),
{fve_sql('label').replace('FROM nrm', 'FROM nrm2')}
SELECT slice, n, round(num, 6) AS mse_nrm,
       round(CASE WHEN den <> 0 THEN 1 - num / den END, 6) AS fve_nrm
FROM agg"""

ORACLES["cosine_summary"] = f"""
WITH {ACT}, {RECON}, {NRM}
SELECT count(*) AS n, round(avg(cos), 6) AS cos_mean,
       round(quantile_disc(cos, 0.5), 6) AS cos_median,
       round(quantile_cont(cos, 0.1), 6) AS cos_p10, round(quantile_cont(cos, 0.9), 6) AS cos_p90
FROM nrm"""

SCORED = """scored AS (
  SELECT d.doc_id, CAST(d.n_chars AS DOUBLE) AS score, l.quality AS label, l.toxic
  FROM documents d JOIN labels l USING (doc_id))"""

ORACLES["auc_ap"] = f"""
WITH {SCORED},
pairs AS (
  SELECT sum(CASE WHEN p.score > q.score THEN 1.0 WHEN p.score = q.score THEN 0.5 ELSE 0.0 END) AS u
  FROM scored p JOIN scored q ON p.label = 1 AND q.label = 0),
cnt AS (SELECT sum(label) AS np, count(*) - sum(label) AS nn FROM scored),
thr AS (
  SELECT s.score, sum(CASE WHEN t.label = 1 THEN 1 ELSE 0 END) AS tp, count(*) AS k,
         (SELECT count(*) FROM scored z WHERE z.score = s.score AND z.label = 1) AS pos_here
  FROM (SELECT DISTINCT score FROM scored) s JOIN scored t ON t.score >= s.score GROUP BY s.score)
SELECT round(pairs.u / (cnt.np * cnt.nn), 6) AS auc_roc,
       round((SELECT sum(pos_here * tp / k) FROM thr) / cnt.np, 6) AS average_precision,
       CAST(cnt.np AS DOUBLE) AS n_pos, CAST(cnt.nn AS DOUBLE) AS n_neg
FROM pairs, cnt"""

# --- sampling -------------------------------------------------------------------


def md5_order(seed: int, key: str) -> str:
    return f"md5('{seed}:' || CAST({key} AS VARCHAR)), {key}"


ORACLES["exact_sample"] = f"""
WITH {ACT}
SELECT row_idx, fraud_score, label FROM act ORDER BY {md5_order(7, 'row_idx')} LIMIT 50"""

ORACLES["head_rows"] = """
SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 20"""

CELLS = f"""cells AS (
  SELECT *, CAST(label AS VARCHAR) || '|' || CAST({score_bin_sql('fraud_score')} AS VARCHAR) AS cell FROM act),
smp AS (SELECT * FROM cells WHERE fraud_score >= 0.5 OR label = 1),
nat AS (SELECT cell, count(*) AS n_population, count(*) / sum(count(*)) OVER () AS p_nat FROM cells GROUP BY cell),
ps AS (SELECT cell, count(*) AS n_sample, count(*) / sum(count(*)) OVER () AS p_smp FROM smp GROUP BY cell),
w AS (
  SELECT ps.cell, coalesce(nat.n_population, 0) AS n_population, ps.n_sample,
         coalesce(nat.p_nat, 0) / ps.p_smp AS raw FROM ps LEFT JOIN nat USING (cell)),
wn AS (SELECT cell, n_population, n_sample,
              raw / (sum(raw * n_sample) OVER () / sum(n_sample) OVER ()) AS weight FROM w)"""

ORACLES["importance_weights"] = f"""
WITH {ACT}, {CELLS}
SELECT nat.cell, nat.n_population, coalesce(wn.n_sample, 0) AS n_sample, round(wn.weight, 6) AS weight
FROM nat LEFT JOIN wn USING (cell)"""

ORACLES["weighted_metric"] = f"""
WITH {ACT}, {CELLS}
SELECT label, count(*) AS n, round(sum(weight * fraud_score) / sum(weight), 6) AS wmean_fraud_score,
       round(avg(fraud_score), 6) AS mean_fraud_score
FROM smp JOIN wn USING (cell) GROUP BY label"""

ORACLES["holdout_carve"] = f"""
WITH {ACT}
SELECT row_idx, CASE WHEN row_number() OVER (ORDER BY {md5_order(5, 'row_idx')}) <= 100
                     THEN 'holdout' ELSE 'pool' END AS part
FROM act"""

ORACLES["derangement"] = f"""
WITH {ACT},
r AS (SELECT row_idx, row_number() OVER (ORDER BY {md5_order(11, 'row_idx')}) - 1 AS rk,
             count(*) OVER () AS n FROM act)
SELECT a.row_idx, b.row_idx AS partner, a.n AS n_rows FROM r a JOIN r b ON b.rk = (a.rk + 1) % a.n"""

ORACLES["rollout_expand"] = """
SELECT conv_id, turn, unnest(range(0, 4)) AS rollout_id FROM conversations"""

# --- preprocessing -------------------------------------------------------------

PREP = f"""{TXN}, {causal_cte('txn')}, {split_cte('feat')},
prep AS (SELECT * EXCLUDE (amt), CASE WHEN txn_id % 50 = 0 THEN NULL ELSE amt END AS amt,
                'd' || CAST((txn_id * 13) % 997 AS VARCHAR) AS device FROM split),
train AS (SELECT * FROM prep WHERE train_split = 'train'),
longc AS (
  SELECT 'merchant' AS col, coalesce(merchant, '__missing__') AS value FROM train
  UNION ALL SELECT 'category', coalesce(category, '__missing__') FROM train
  UNION ALL SELECT 'device', coalesce(device, '__missing__') FROM train),
cnt AS (SELECT col, value, count(*) AS n FROM longc GROUP BY col, value),
nu AS (SELECT col, count(*) AS n_unique FROM cnt GROUP BY col),
rk AS (SELECT col, value, row_number() OVER (PARTITION BY col ORDER BY n DESC, value) AS r FROM cnt),
top AS (SELECT rk.col, rk.value FROM rk JOIN nu USING (col) WHERE nu.n_unique <= 200 OR rk.r <= 200),
voc0 AS (
  SELECT col, value FROM top
  UNION SELECT col, '__rare__' FROM nu WHERE n_unique > 200
  UNION SELECT col, s FROM nu, (VALUES ('__missing__'), ('__unknown__'), ('__rare__')) t(s)),
voc AS (SELECT col, value, CAST(row_number() OVER (PARTITION BY col ORDER BY value) - 1 AS INTEGER) AS id FROM voc0),
clipped AS (
  SELECT *, greatest(least(amt_zscore, 10.0), -10.0) AS c_amt_zscore,
         CAST(greatest(least(velocity_1h, 200), 0) AS DOUBLE) AS c_velocity_1h,
         CAST(greatest(least(velocity_24h, 1000), 0) AS DOUBLE) AS c_velocity_24h FROM prep),
longn AS (
  SELECT 'amt' AS col, CAST(amt AS DOUBLE) AS x FROM clipped WHERE train_split = 'train'
  UNION ALL SELECT 'hour_of_day', CAST(hour_of_day AS DOUBLE) FROM clipped WHERE train_split = 'train'
  UNION ALL SELECT 'day_of_week', CAST(day_of_week AS DOUBLE) FROM clipped WHERE train_split = 'train'
  UNION ALL SELECT 'amt_zscore', c_amt_zscore FROM clipped WHERE train_split = 'train'
  UNION ALL SELECT 'velocity_1h', c_velocity_1h FROM clipped WHERE train_split = 'train'
  UNION ALL SELECT 'velocity_24h', c_velocity_24h FROM clipped WHERE train_split = 'train'
  UNION ALL SELECT 'card_tenure_days', card_tenure_days FROM clipped WHERE train_split = 'train'),
med AS (SELECT col, quantile_cont(x, 0.5) AS median FROM longn GROUP BY col),
st AS (SELECT l.col, avg(coalesce(l.x, m.median)) AS mean, stddev_pop(coalesce(l.x, m.median)) AS std
       FROM longn l JOIN med m USING (col) GROUP BY l.col),
stats AS (SELECT col, median, mean, std, CASE WHEN std = 0 OR std IS NULL THEN 1.0 ELSE std END AS scale
          FROM med JOIN st USING (col))"""

ORACLES["preprocess_vocab"] = f"""
WITH {PREP}
SELECT col, value, id FROM voc"""

ORACLES["preprocess_num_stats"] = f"""
WITH {PREP}
SELECT col, round(median, 6) AS median, round(mean, 6) AS mean, round(std, 6) AS std,
       round(scale, 6) AS scale FROM stats"""


def _cat_id(c: str) -> str:
    mapped = (f"CASE WHEN (SELECT n_unique FROM nu WHERE col = '{c}') > 200 "
              f"AND coalesce({c}, '__missing__') NOT IN (SELECT value FROM top WHERE col = '{c}') "
              f"THEN '__rare__' ELSE coalesce({c}, '__missing__') END")
    return (f"coalesce((SELECT id FROM voc WHERE col = '{c}' AND value = {mapped}), "
            f"(SELECT id FROM voc WHERE col = '{c}' AND value = '__unknown__')) AS {c}_id")


def _scaled(c: str, expr: str) -> str:
    s = f"(SELECT {{}} FROM stats WHERE col = '{c}')"
    filled = f"coalesce({expr}, {s.format('median')})"
    centred = f"CAST(CAST(CAST({filled} AS FLOAT) AS DOUBLE) - {s.format('mean')} AS FLOAT)"
    return f"round(CAST(CAST(CAST({centred} AS DOUBLE) / {s.format('scale')} AS FLOAT) AS DOUBLE), 6) AS {c}_scaled"


ORACLES["preprocess_apply"] = f"""
WITH {PREP}
SELECT txn_id, train_split, {_cat_id('merchant')}, {_cat_id('category')}, {_cat_id('device')},
       {_scaled('amt', 'CAST(amt AS DOUBLE)')}, {_scaled('hour_of_day', 'CAST(hour_of_day AS DOUBLE)')},
       {_scaled('day_of_week', 'CAST(day_of_week AS DOUBLE)')}, {_scaled('amt_zscore', 'c_amt_zscore')},
       {_scaled('velocity_1h', 'c_velocity_1h')}, {_scaled('velocity_24h', 'c_velocity_24h')},
       {_scaled('card_tenure_days', 'card_tenure_days')}
FROM clipped"""

ORACLES["positive_weight"] = f"""
WITH {PREP}
SELECT CAST(sum(CASE WHEN is_fraud = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_neg,
       CAST(sum(CASE WHEN is_fraud = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_pos,
       round(sum(CASE WHEN is_fraud = 0 THEN 1 ELSE 0 END)
             / greatest(1, sum(CASE WHEN is_fraud = 1 THEN 1 ELSE 0 END)), 6) AS pos_weight
FROM train"""

# --- journal, text, rollouts ----------------------------------------------------

ORACLES["latest_by_key"] = """
SELECT conv_id, turn, role, text FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations)
WHERE r = 1"""

JOURNAL = """jr AS (
  SELECT doc_id AS row_idx, text AS summary, 0 AS seq FROM documents
  UNION ALL SELECT doc_id, text || ' (rerun)', 1 FROM documents WHERE lang = 'de'),
latest AS (SELECT row_idx, summary FROM (
  SELECT *, row_number() OVER (PARTITION BY row_idx ORDER BY seq DESC) AS r FROM jr) WHERE r = 1),
nb AS (SELECT * FROM latest WHERE length(regexp_replace(summary, '^\\s+|\\s+$', '', 'g')) > 0)"""

ORACLES["journal_pairs"] = f"""
WITH {ACT}, {JOURNAL}
SELECT nb.row_idx, act.activation_vector IS NOT NULL AS has_vector, act.label, act.fraud_score,
       length(nb.summary) AS summary_chars, md5(nb.summary) AS summary_md5
FROM nb LEFT JOIN act USING (row_idx)"""

ORACLES["pending_work"] = f"""
WITH {ACT},
smp AS (SELECT row_idx FROM act ORDER BY {md5_order(9, 'row_idx')} LIMIT 300),
done AS (SELECT doc_id AS row_idx FROM documents
         WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 0 AND lang <> 'fr')
SELECT row_idx FROM smp WHERE row_idx NOT IN (SELECT row_idx FROM done)"""

STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"

EXPL = f"""ex0 AS (
  SELECT conv_id, turn, {STRIP.format(x='text')} AS s FROM conversations),
ex1 AS (
  SELECT conv_id, turn,
         CASE WHEN starts_with(s, '<explanation>') THEN s
              ELSE '<explanation>' || chr(10) || s || chr(10) || '</explanation>' END AS wrapped
  FROM ex0),
ex AS (
  SELECT conv_id, turn, wrapped,
         CASE WHEN turn % 3 = 0 THEN regexp_replace(wrapped, '\\n</explanation>$', '') ELSE wrapped END AS raw
  FROM ex1),
px AS (
  SELECT *, CASE
      WHEN regexp_matches(raw, '(?s)<explanation>\\s*(.*?)\\s*</explanation>')
        THEN regexp_extract(raw, '(?s)<explanation>\\s*(.*?)\\s*</explanation>', 1)
      WHEN strpos(raw, '<explanation>') > 0
        THEN {STRIP.format(x="substr(raw, strpos(raw, '<explanation>') + 13)")}
      ELSE {STRIP.format(x='raw')} END AS parsed,
      strpos(raw, '</explanation>') > 0 AS has_close_tag
  FROM ex)"""

ORACLES["explanations"] = f"""
WITH {EXPL}
SELECT conv_id, turn, wrapped, parsed, has_close_tag FROM px"""

ORACLES["text_stats"] = f"""
WITH {EXPL}
SELECT count(*) AS n, round(avg(length(parsed)), 6) AS mean_explanation_chars,
       round(100.0 * avg(CASE WHEN has_close_tag THEN 0.0 ELSE 1.0 END), 6) AS pct_missing_close_tag
FROM px"""

TOKSET = "list_distinct(list_filter(string_split_regex({x}, '\\s+'), lambda t: t <> ''))"

ORACLES["token_jaccard"] = f"""
WITH p AS (
  SELECT a.conv_id, a.turn, {TOKSET.format(x='a.text')} AS ta, {TOKSET.format(x='b.text')} AS tb
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, round(CASE WHEN len(ta) = 0 AND len(tb) = 0 THEN 1.0
                                 WHEN len(ta) = 0 OR len(tb) = 0 THEN 0.0
                                 ELSE len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))) END, 6) AS jaccard
FROM p"""

ORACLES["cache_keys"] = """
SELECT doc_id, substr(md5(CAST(doc_id AS VARCHAR) || ':m'), 1, 16) AS cache_key FROM documents"""

ROLL = """ro0 AS (
  SELECT conv_id AS group_id, turn AS rollout_id, conv_id % 5 AS step,
         CAST(-(length(text) % 97) AS DOUBLE) / 97.0 AS reward,
         list_transform(string_split(text, ' '), lambda w: CAST(length(w) % 10 AS INTEGER)) AS ids
  FROM conversations),
ro AS (
  SELECT *, list_position(ids, 9) AS pos FROM ro0),
ro2 AS (
  SELECT *, list_transform(range(1, len(ids) + 1), lambda i: CASE WHEN pos IS NULL OR i <= pos THEN 1 ELSE 0 END) AS mask
  FROM ro),
ro3 AS (
  SELECT *, list_sum(mask) AS completion_len,
         list_sum(list_transform(range(1, len(ids) + 1), lambda i:
           (exp((-0.12 * ids[i] + 0.01) - (-0.1 * ids[i])) - ((-0.12 * ids[i] + 0.01) - (-0.1 * ids[i])) - 1.0) * mask[i]))
           / greatest(1.0, list_sum(mask)) AS kl
  FROM ro2)"""

ORACLES["rollout_advantage"] = f"""
WITH {ROLL}
SELECT group_id, rollout_id, round(reward, 6) AS reward,
       round(CASE WHEN stddev_samp(reward) OVER g IS NOT NULL
             THEN (reward - avg(reward) OVER g) / (stddev_samp(reward) OVER g + 1e-4) END, 6) AS advantage
FROM ro0 WINDOW g AS (PARTITION BY group_id)"""

ORACLES["rollout_report"] = f"""
WITH {ROLL}
SELECT step, count(*) AS n, round(avg(reward), 6) AS mean_reward, round(avg(-reward), 6) AS mean_mse,
       round(avg(completion_len), 6) AS mean_completion_len, round(avg(kl), 6) AS mean_kl
FROM ro3 GROUP BY step"""

# --- controls and geometry -----------------------------------------------------

RT = f"""{ACT}, {RECON},
rt AS (
  SELECT r.*, CASE WHEN starts_with(s, '<explanation>') THEN s
                   ELSE '<explanation>' || chr(10) || s || chr(10) || '</explanation>' END AS wrapped
  FROM (SELECT r0.*, {STRIP.format(x="coalesce(d.text, '')")} AS s
        FROM recon r0 LEFT JOIN documents d ON d.doc_id = r0.row_idx) r),
rt2 AS (SELECT *, CASE WHEN row_idx % 4 = 0 THEN regexp_replace(wrapped, '\\n</explanation>$', '') ELSE wrapped END AS raw FROM rt),
rt3 AS (SELECT *, CASE
      WHEN regexp_matches(raw, '(?s)<explanation>\\s*(.*?)\\s*</explanation>')
        THEN regexp_extract(raw, '(?s)<explanation>\\s*(.*?)\\s*</explanation>', 1)
      WHEN strpos(raw, '<explanation>') > 0
        THEN {STRIP.format(x="substr(raw, strpos(raw, '<explanation>') + 13)")}
      ELSE {STRIP.format(x='raw')} END AS parsed FROM rt2)"""


def fve_long(src: str) -> str:
    """FVE / MSE / cosine per condition of a long (condition, row_idx, g, p)
    table, by definition."""
    return f"""ln AS (
  SELECT condition, row_idx, len(g) AS d, {_to_metric('g', 'len(g)')} AS gn, {_to_metric('p', 'len(g)')} AS pn,
         list_sum(list_transform(range(1, len(g) + 1), lambda i: g[i] * p[i]))
           / greatest({_norm('g')} * {_norm('p')}, 1e-8) AS cos
  FROM {src}),
ldims AS (SELECT condition, row_idx, unnest(range(1, d + 1)) AS i, unnest(gn) AS gv, unnest(pn) AS pv FROM ln),
lmu AS (SELECT condition, i, avg(gv) AS m FROM ldims GROUP BY condition, i),
lagg AS (
  SELECT d.condition, avg((d.pv - d.gv) * (d.pv - d.gv)) AS num, avg((d.gv - lmu.m) * (d.gv - lmu.m)) AS den
  FROM ldims d JOIN lmu ON d.condition = lmu.condition AND d.i = lmu.i GROUP BY d.condition),
lcos AS (SELECT condition, count(*) AS n, avg(cos) AS cos_mean, quantile_disc(cos, 0.5) AS cos_median,
                quantile_cont(cos, 0.1) AS cos_p10, quantile_cont(cos, 0.9) AS cos_p90 FROM ln GROUP BY condition),
lres AS (SELECT lcos.*, lagg.num AS mse_nrm, CASE WHEN lagg.den <> 0 THEN 1 - lagg.num / lagg.den END AS fve_nrm
         FROM lcos JOIN lagg USING (condition))"""


ORACLES["roundtrip_report"] = f"""
WITH {RT},
lsrc AS (SELECT 'all' AS condition, row_idx, g, p FROM rt3
         UNION ALL SELECT 'fraud', row_idx, g, p FROM rt3 WHERE label = 1),
{fve_long('lsrc')},
t AS (SELECT count(*) AS n, CAST(sum(label) AS BIGINT) AS n_fraud, avg(length(parsed)) AS mean_explanation_chars,
             100.0 * avg(CASE WHEN strpos(raw, '</explanation>') > 0 THEN 0.0 ELSE 1.0 END) AS pct_missing_close_tag
      FROM rt3)
SELECT t.n, t.n_fraud, round(a.fve_nrm, 6) AS fve_nrm, round(a.mse_nrm, 6) AS mse_nrm,
       round(a.cos_mean, 6) AS cos_mean, round(a.cos_median, 6) AS cos_median,
       round(a.cos_p10, 6) AS cos_p10, round(a.cos_p90, 6) AS cos_p90,
       round(CASE WHEN f.n > 10 THEN f.fve_nrm END, 6) AS fve_fraud_slice,
       round(t.mean_explanation_chars, 6) AS mean_explanation_chars,
       round(t.pct_missing_close_tag, 6) AS pct_missing_close_tag
FROM t, (SELECT * FROM lres WHERE condition = 'all') a LEFT JOIN (SELECT * FROM lres WHERE condition = 'fraud') f ON true"""

SWAP = f"""{RT},
der AS (SELECT a.row_idx, b.row_idx AS partner FROM
  (SELECT row_idx, row_number() OVER (ORDER BY {md5_order(0, 'row_idx')}) - 1 AS rk, count(*) OVER () AS n FROM act) a
  JOIN (SELECT row_idx, row_number() OVER (ORDER BY {md5_order(0, 'row_idx')}) - 1 AS rk FROM act) b
  ON b.rk = (a.rk + 1) % a.n),
base AS (SELECT r.row_idx, r.g, r.p, s.p AS sp, r.parsed AS t, s.parsed AS st
         FROM rt3 r JOIN der USING (row_idx) JOIN rt3 s ON s.row_idx = der.partner),
mu AS (SELECT list(m ORDER BY i) AS mu FROM (
  SELECT i, avg(gv / greatest(nrm, 1e-12)) AS m FROM (
    SELECT unnest(range(1, len(g) + 1)) AS i, unnest(g) AS gv, {_norm('g')} AS nrm FROM rt3) GROUP BY i)),
lsrc AS (SELECT 'real' AS condition, row_idx, g, p FROM base
         UNION ALL SELECT 'swap', row_idx, g, sp FROM base
         UNION ALL SELECT 'floor', row_idx, g, mu FROM base, mu),
{fve_long('lsrc')}"""

ORACLES["swap_control_metrics"] = f"""
WITH {SWAP}
SELECT condition, n, round(fve_nrm, 6) AS fve_nrm, round(mse_nrm, 6) AS mse_nrm,
       round(cos_mean, 6) AS cos_mean, round(cos_median, 6) AS cos_median FROM lres"""

ORACLES["swap_control_verdict"] = f"""
WITH {SWAP},
jac AS (SELECT CASE WHEN len(ta) = 0 AND len(tb) = 0 THEN 1.0 WHEN len(ta) = 0 OR len(tb) = 0 THEN 0.0
                    ELSE len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))) END AS j
        FROM (SELECT {TOKSET.format(x='t')} AS ta, {TOKSET.format(x='st')} AS tb FROM base)),
v AS (SELECT max(fve_nrm) FILTER (WHERE condition = 'real') AS r,
             max(fve_nrm) FILTER (WHERE condition = 'swap') AS s,
             max(fve_nrm) FILTER (WHERE condition = 'floor') AS f FROM lres)
SELECT round(r, 6) AS real_fve, round(s, 6) AS swap_fve, round(f, 6) AS floor_fve,
       round(r - s, 6) AS gap_real_minus_swap_fve, round(s - f, 6) AS gap_swap_minus_floor_fve,
       round((SELECT avg(j) FROM jac), 6) AS jaccard_mean,
       round((SELECT quantile_cont(j, 0.5) FROM jac), 6) AS jaccard_median,
       CASE WHEN s - f <= 0.05 AND r - s >= 0.15 THEN 'PASS' WHEN r - s < 0.05 THEN 'FAIL'
            ELSE 'AMBIGUOUS' END AS verdict
FROM v"""

ORACLES["pairwise_geometry"] = f"""
WITH {ACT}, {RECON},
u AS (SELECT row_idx, list_transform(g, lambda x: x / ({_norm('g')} + 1e-12)) AS a,
             list_transform(p, lambda x: x / ({_norm('p')} + 1e-12)) AS b FROM recon),
pr AS (SELECT list_sum(list_transform(range(1, len(x.a) + 1), lambda i: x.a[i] * y.a[i])) AS ci,
              list_sum(list_transform(range(1, len(x.b) + 1), lambda i: x.b[i] * y.b[i])) AS co
       FROM u x JOIN u y ON x.row_idx < y.row_idx)
SELECT count(*) AS n_pairs, round(avg(ci), 6) AS in_mean, round(stddev_pop(ci), 6) AS in_std,
       round(avg(co), 6) AS out_mean, round(stddev_pop(co), 6) AS out_std, round(corr(ci, co), 6) AS pearson_r
FROM pr"""

ORACLES["pair_order_statistics"] = f"""
WITH {ACT}, {RECON},
u AS (SELECT row_idx, list_transform(g, lambda x: x / ({_norm('g')} + 1e-12)) AS a,
             list_transform(p, lambda x: x / ({_norm('p')} + 1e-12)) AS b FROM recon),
pr AS (SELECT round(ci_, 12) AS ci, round(co_, 12) AS co FROM (SELECT list_sum(list_transform(range(1, len(x.a) + 1), lambda i: x.a[i] * y.a[i])) AS ci_,
              list_sum(list_transform(range(1, len(x.b) + 1), lambda i: x.b[i] * y.b[i])) AS co_
       FROM u x JOIN u y ON x.row_idx < y.row_idx)),
rk AS (SELECT *, rank() OVER (ORDER BY ci) + (count(*) OVER (PARTITION BY ci) - 1) / 2.0 AS ri,
                 rank() OVER (ORDER BY co) + (count(*) OVER (PARTITION BY co) - 1) / 2.0 AS ro FROM pr)
SELECT count(*) AS n_pairs,
       {', '.join(f"round(quantile_cont({c}, {q}), 6) AS {side}_{name}" for side, c in (("in", "ci"), ("out", "co")) for name, q in (("median", 0.5), ("p5", 0.05), ("p95", 0.95)))},
       round(corr(ri, ro), 6) AS spearman_r, CAST(0 AS DOUBLE) AS rank_resolution
FROM rk"""

ORACLES["embedding_space"] = f"""
WITH {ACT}, {RECON},
nr AS (SELECT {_norm('g')} AS nrm FROM recon),
md AS (SELECT list(m ORDER BY i) AS m FROM (
  SELECT i, avg(v) AS m FROM (SELECT unnest(range(1, len(g) + 1)) AS i, unnest(g) AS v FROM recon) GROUP BY i)),
mdn AS (SELECT list_transform(m, lambda x: x / ({_norm('m')} + 1e-12)) AS mn FROM md),
cm AS (SELECT list_sum(list_transform(range(1, len(p) + 1), lambda i: p[i] / ({_norm('p')} + 1e-12) * mn[i])) AS c
       FROM recon, mdn),
un AS (SELECT row_idx, list_transform(p, lambda x: x / ({_norm('p')} + 1e-12)) AS up,
              list_transform(g, lambda x: x / ({_norm('g')} + 1e-12)) AS ug FROM recon),
cr AS (SELECT avg(list_sum(list_transform(range(1, len(a.up) + 1), lambda i: a.up[i] * b.ug[i]))) AS c
       FROM un a, un b),
rf AS (SELECT ug FROM un ORDER BY {md5_order(11, 'row_idx')} LIMIT 200),
cf AS (SELECT list_sum(list_transform(range(1, len(a.up) + 1), lambda i: a.up[i] * b.ug[i])) AS c FROM un a, rf b)
SELECT round((SELECT avg(c) FROM cf), 6) AS cos_reference_mean, round((SELECT stddev_pop(c) FROM cf), 6) AS cos_reference_std,
       round((SELECT quantile_cont(c, 0.5) FROM cf), 6) AS cos_reference_median,
       round((SELECT quantile_cont(c, 0.05) FROM cf), 6) AS cos_reference_p5,
       round((SELECT quantile_cont(c, 0.95) FROM cf), 6) AS cos_reference_p95,
       round((SELECT avg(nrm) FROM nr), 6) AS norm_mean, round((SELECT stddev_samp(nrm) FROM nr), 6) AS norm_std,
       round((SELECT quantile_disc(nrm, 0.5) FROM nr), 6) AS norm_median,
       round((SELECT quantile_cont(nrm, 0.05) FROM nr), 6) AS norm_p5,
       round((SELECT quantile_cont(nrm, 0.95) FROM nr), 6) AS norm_p95,
       round((SELECT avg(c) FROM cm), 6) AS cos_mean_dir_mean,
       round((SELECT quantile_cont(c, 0.5) FROM cm), 6) AS cos_mean_dir_median,
       round((SELECT quantile_cont(c, 0.05) FROM cm), 6) AS cos_mean_dir_p5,
       round((SELECT quantile_cont(c, 0.95) FROM cm), 6) AS cos_mean_dir_p95,
       round((SELECT c FROM cr), 6) AS cos_random_mean"""

# --- evaluations specified by the plan ------------------------------------------

PRED = f"""{ACT},
truth AS (SELECT row_idx, label, {score_bin_sql('fraud_score')} AS score_bin, class_id FROM act),
cmaj AS (SELECT class_id AS common FROM (SELECT class_id, count(*) AS c FROM act GROUP BY class_id) ORDER BY c DESC, class_id LIMIT 1),
tr AS (SELECT * FROM act),
maj AS (SELECT label AS majority_label FROM (SELECT label, count(*) AS c FROM tr GROUP BY label)
        ORDER BY c DESC, label LIMIT 1),
mean AS (SELECT avg(fraud_score) AS ms FROM tr),
sh AS (SELECT row_idx, ((row_idx * 37 + 5) % 101) / 100.0 AS s FROM act),
pred AS (
  SELECT 'shifted' AS system, row_idx, {score_bin_sql('s')} AS pred_bin, CAST(s >= 0.5 AS INTEGER) AS pred_label, (row_idx * 7 + 3) % 10 AS pred_class FROM sh
  UNION ALL
  SELECT 'majority', row_idx, {score_bin_sql('ms')}, majority_label, common FROM act, maj, mean, cmaj),
acc AS (
  SELECT system, 'score_bucket' AS task, count(*) AS n, avg(CAST(pred_bin = score_bin AS DOUBLE)) AS accuracy
  FROM pred JOIN truth USING (row_idx) GROUP BY system
  UNION ALL
  SELECT system, 'label', count(*), avg(CAST(pred_label = label AS DOUBLE))
  FROM pred JOIN truth USING (row_idx) GROUP BY system
  UNION ALL
  SELECT system, 'masked_feature', count(*), avg(CAST(pred_class = class_id AS DOUBLE))
  FROM pred JOIN truth USING (row_idx) GROUP BY system)"""

ORACLES["accuracy_by_system"] = f"""
WITH {PRED}
SELECT system, task, n, round(accuracy, 6) AS accuracy FROM acc"""

ORACLES["comparison_table"] = f"""
WITH {PRED}
SELECT system, round(max(accuracy) FILTER (WHERE task = 'score_bucket'), 6) AS score_bucket,
       round(max(accuracy) FILTER (WHERE task = 'label'), 6) AS label,
       round(max(accuracy) FILTER (WHERE task = 'masked_feature'), 6) AS masked_feature
FROM acc GROUP BY system"""

ORACLES["model_error_slice"] = f"""
WITH {ACT}
SELECT label, {score_bin_sql('fraud_score')} AS score_bin, count(*) AS n FROM act
WHERE ({score_bin_sql('fraud_score')} >= 3 AND label = 0) OR ({score_bin_sql('fraud_score')} <= 1 AND label = 1)
GROUP BY ALL"""

_CLAIMS = [("amount", r"Amount: \$([0-9.]+)", "amt", 0.005),
           ("hour", r"Time: ([0-9]{2}):xx", "hour_of_day", 0.0),
           ("velocity_1h", r"Card velocity: ([0-9]+) txn in past 1h", "velocity_1h", 0.0),
           ("velocity_24h", r"Card velocity: ([0-9]+) txn in past 24h", "velocity_24h", 0.0),
           ("zscore", r"z=([+-][0-9.]+) ", "amt_zscore", 0.05),
           ("tenure", r"Card tenure: ([0-9]+) day", "card_tenure_days", 0.5)]

ORACLES["claim_precision"] = f"""
WITH {TXN}, {causal_cte('txn')},
cp AS (SELECT txn_id, merchant, category, amt, hour_of_day, day_of_week, velocity_1h, velocity_24h,
              amt_zscore, card_tenure_days, CAST(NULL AS DOUBLE) AS geo_distance_km,
              CAST(NULL AS DOUBLE) AS age_at_txn, CAST(NULL AS DOUBLE) AS fraud_score FROM feat),
r AS (SELECT txn_id, {RENDER_CP_SQL} AS rendered FROM cp),
cl AS ({' UNION ALL '.join(f"SELECT txn_id, '{k}' AS kind, regexp_extract(rendered, '{p}', 1) AS v FROM r" for k, p, _, _ in _CLAIMS)}),
tv AS ({' UNION ALL '.join(f"SELECT txn_id, '{k}' AS kind, CAST({c} AS DOUBLE) AS tv, {t} AS tol FROM feat" for k, _, c, t in _CLAIMS)})
SELECT kind, count(*) AS n_claims,
       round(avg(CAST(abs(CAST(v AS DOUBLE) - tv) <= tol + 1e-9 AS DOUBLE)), 6) AS precision
FROM cl JOIN tv USING (txn_id, kind) WHERE v <> '' GROUP BY kind"""

ORACLES["holdout_overlap"] = f"""
WITH {ACT},
hold AS (SELECT row_idx FROM act ORDER BY {md5_order(5, 'row_idx')} LIMIT 100),
pool AS (SELECT * FROM act WHERE row_idx NOT IN (SELECT row_idx FROM hold)),
train AS (SELECT row_idx FROM pool ORDER BY {md5_order(6, 'row_idx')} LIMIT 200)
SELECT CAST(count(*) AS BIGINT) AS n_overlap FROM train WHERE row_idx IN (SELECT row_idx FROM hold)"""

_NUM_EXPR = {"amt": "CAST(amt AS DOUBLE)", "hour_of_day": "CAST(hour_of_day AS DOUBLE)",
             "day_of_week": "CAST(day_of_week AS DOUBLE)", "amt_zscore": "c_amt_zscore",
             "velocity_1h": "c_velocity_1h", "velocity_24h": "c_velocity_24h",
             "card_tenure_days": "card_tenure_days"}


def _scaled_raw(c: str, expr: str) -> str:
    s = f"(SELECT {{}} FROM stats WHERE col = '{c}')"
    filled = f"coalesce({expr}, {s.format('median')})"
    centred = f"CAST(CAST(CAST({filled} AS FLOAT) AS DOUBLE) - {s.format('mean')} AS FLOAT)"
    return f"CAST(CAST(CAST({centred} AS DOUBLE) / {s.format('scale')} AS FLOAT) AS DOUBLE) AS {c}"


ORACLES["attribution_text"] = f"""
WITH {PREP},
applied AS (SELECT txn_id, train_split, is_fraud, {', '.join(_scaled_raw(c, e) for c, e in _NUM_EXPR.items())}
            FROM clipped),
w AS (SELECT {', '.join(f"corr({c}, CAST(is_fraud AS DOUBLE)) AS {c}" for c in _NUM_EXPR)}
      FROM applied WHERE train_split = 'train'),
longa AS ({' UNION ALL '.join(f"SELECT a.txn_id, '{c}' AS name, a.{c} * w.{c} AS v FROM applied a, w" for c in _NUM_EXPR)}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY txn_id ORDER BY abs(v) DESC, v DESC, name DESC) AS r
           FROM longa WHERE v IS NOT NULL AND NOT isnan(v))
SELECT txn_id, string_agg(printf('  %s: %+.3f', name, v), chr(10) ORDER BY r) AS attributions
FROM ranked WHERE r <= 5 GROUP BY txn_id"""

ORACLES["distribution_block"] = f"""
WITH {ACT}, {RECON}, {NRM}
SELECT label, count(*) AS n, round(avg(cos), 6) AS mean, round(quantile_cont(cos, 0.5), 6) AS median,
       round(quantile_cont(cos, 0.05), 6) AS p5, round(quantile_cont(cos, 0.95), 6) AS p95,
       round(stddev_pop(cos), 6) AS std
FROM nrm GROUP BY label"""


def _steering_sql() -> str:
    from txnlens.plans.registry import STEER_ALPHAS, random_direction
    d = 64
    rnd = random_direction(d)
    rlist = "[" + ", ".join(repr(x) for x in rnd) + "]"
    alphas = ", ".join(f"(CAST({a!r} AS DOUBLE))" for a in STEER_ALPHAS)
    return f"""
WITH {ACT},
dims AS (SELECT label, unnest(range(1, len(activation_vector) + 1)) AS i,
                unnest(CAST(activation_vector AS DOUBLE[])) AS v FROM act),
m AS (SELECT label, i, avg(v) AS mv FROM dims GROUP BY label, i),
delta AS (SELECT list(m1.mv - m0.mv ORDER BY m1.i) AS dl FROM m m1 JOIN m m0 ON m1.i = m0.i
          WHERE m1.label = 1 AND m0.label = 0),
sdims AS (SELECT unnest(range(1, len(activation_vector) + 1)) AS i, unnest(CAST(activation_vector AS DOUBLE[])) AS v,
                 fraud_score AS s FROM act),
dirs AS (SELECT 'class_mean' AS direction, dl AS u FROM delta
         UNION ALL SELECT 'random', CAST({rlist} AS DOUBLE[])
         UNION ALL SELECT 'probe', (SELECT list(c ORDER BY i) FROM (SELECT i, covar_pop(v, s) AS c FROM sdims GROUP BY i))),
dn AS (SELECT direction, list_transform(u, lambda x: x / ({_norm('u')} + 1e-12)) AS un FROM dirs),
sd AS (SELECT list_transform(dl, lambda x: x / ({_norm('dl')} + 1e-12)) AS s FROM delta),
al AS (SELECT * FROM (VALUES {alphas}) t(alpha)),
st AS (
  SELECT dn.direction, al.alpha,
         list_transform(range(1, len(a.activation_vector) + 1),
           lambda i: CAST(a.activation_vector[i] AS DOUBLE)
             + al.alpha * {_norm('CAST(a.activation_vector AS DOUBLE[])')} * dn.un[i]) AS h2
  FROM act a, dn, al),
sc AS (
  SELECT direction, alpha,
         list_sum(list_transform(range(1, len(h2) + 1), lambda i: h2[i] * sd.s[i]))
           / greatest({_norm('h2')} * {_norm('sd.s')}, 1e-8) AS score
  FROM st, sd)
SELECT direction, alpha, count(*) AS n, round(avg(score), 6) AS mean_score FROM sc GROUP BY direction, alpha"""


ORACLES["steering_sweep"] = _steering_sql()


def _steering_network_sql() -> str:
    """Two layers with weights from md5; erf(x) = exp(-x^2) sum x^(2n+1) / gamma(n + 3/2)."""
    from txnlens.plans.registry import STEER_HIDDEN
    head = _steering_sql().split("sd AS (SELECT list_transform(dl")[0]
    frac = lambda name, d: f"((('0x' || substr(md5({name}), 1, 13))::BIGINT / {float(16 ** 13)!r}) * 2.0 - 1.0) * {(3.0 / d) ** 0.5!r}"
    erf = "(sign({x}) * exp(-(least(abs({x}), 6.0) ** 2)) * list_sum(list_transform(range(0, 120), lambda k: CASE WHEN {x} = 0 THEN 0 ELSE exp((2 * k + 1) * ln(least(abs({x}), 6.0)) - lgamma(k + 1.5)) END)))"
    return head + f"""al AS (SELECT unnest([0.0, {', '.join(repr(x) for x in _alphas())}]::DOUBLE[]) AS alpha),
w1 AS (SELECT r, list({frac("'0:0:' || r || ':' || j", 64)} ORDER BY j) AS w FROM range({STEER_HIDDEN}) a(r), range(64) b(j) GROUP BY r),
w2 AS (SELECT j AS r, {frac("'0:1:0:' || j", STEER_HIDDEN)} AS v FROM range({STEER_HIDDEN}) b(j)),
st AS (SELECT dn.direction, al.alpha, a.row_idx,
              list_transform(range(1, len(a.activation_vector) + 1), lambda i: CAST(a.activation_vector[i] AS DOUBLE)
                             + al.alpha * {_norm('CAST(a.activation_vector AS DOUBLE[])')} * dn.un[i]) AS h FROM act a, dn, al),
z AS (SELECT direction, alpha, row_idx, v, list_sum(list_transform(range(1, 65), lambda i: h[i] * w[i])) AS z FROM st, w1 JOIN w2 USING (r)),
e AS (SELECT direction, alpha, row_idx, 1 / (1 + exp(-sum(v * 0.5 * z * (1 + {erf.format(x='(z / sqrt(2.0))')})))) AS s FROM z GROUP BY direction, alpha, row_idx),
d AS (SELECT e.*, o.s AS own FROM e JOIN e o ON o.direction = e.direction AND o.row_idx = e.row_idx AND o.alpha = 0)
SELECT direction, alpha, count(*) AS n, round(avg(s), 6) AS mean_score, round(avg(s - own), 6) AS mean_shift,
       round(avg(CASE WHEN s < own THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS share_lower FROM d GROUP BY direction, alpha"""


def _alphas() -> list[float]:
    from txnlens.plans.registry import STEER_ALPHAS
    return STEER_ALPHAS


ORACLES["steering_network"] = _steering_network_sql()


def stratified_sql(n: int, natural_frac: float, seed: int) -> str:
    """Stratified sample by its definition: natural part = the smallest
    hashes overall; quotas water-filled over the sorted cells round by round
    (a recursive CTE); per cell the smallest hashes of the remaining pool;
    weights p_nat / p_smp over their mean."""
    n_nat = int(round(n * natural_frac))
    return f"""
WITH RECURSIVE {ACT},
cells AS (SELECT *, CAST(label AS VARCHAR) || '|' || CAST({score_bin_sql('fraud_score')} AS VARCHAR) AS cell,
                 md5('{seed}:' || CAST(row_idx AS VARCHAR)) AS h FROM act),
nsz AS (SELECT least({n}, count(*)) AS n FROM cells),
nat AS (SELECT row_idx FROM cells ORDER BY h, row_idx LIMIT {n_nat}),
pool AS (SELECT * FROM cells WHERE row_idx NOT IN (SELECT row_idx FROM nat)),
pc AS (SELECT list(cell ORDER BY cell) AS cs, list(p ORDER BY cell) AS ps
       FROM (SELECT cell, count(*) AS p FROM pool GROUP BY cell)),
wf(r, rem, lefts, quotas) AS (
  SELECT 0, (SELECT n FROM nsz) - {n_nat}, ps, list_transform(ps, lambda x: 0) FROM pc
  UNION ALL
  SELECT r + 1, rem - list_sum(takes),
         list_transform(range(1, len(lefts) + 1), lambda i: lefts[i] - takes[i]),
         list_transform(range(1, len(quotas) + 1), lambda i: quotas[i] + takes[i])
  FROM (
    SELECT r, rem, lefts, quotas,
           list_transform(range(1, len(lefts) + 1), lambda i: greatest(0, least(
             least(per, lefts[i]),
             rem - coalesce(list_sum(list_transform(list_slice(lefts, 1, i - 1), lambda x: least(per, x))), 0)))) AS takes
    FROM (SELECT *, greatest(1, rem // len(list_filter(lefts, lambda x: x > 0))) AS per FROM wf
          WHERE rem > 0 AND len(list_filter(lefts, lambda x: x > 0)) > 0))),
fq AS (SELECT unnest(pc.cs) AS cell, unnest(quotas) AS quota
       FROM (SELECT quotas FROM wf ORDER BY r DESC LIMIT 1), pc),
ranked AS (SELECT pool.*, row_number() OVER (PARTITION BY cell ORDER BY h, row_idx) AS k FROM pool),
smp AS (SELECT ranked.* EXCLUDE (k) FROM ranked JOIN fq USING (cell) WHERE k <= quota
        UNION ALL SELECT * FROM cells WHERE row_idx IN (SELECT row_idx FROM nat)),
pn AS (SELECT cell, count(*) / sum(count(*)) OVER () AS p_nat FROM cells GROUP BY cell),
ps2 AS (SELECT cell, count(*) AS k, count(*) / sum(count(*)) OVER () AS p_smp FROM smp GROUP BY cell),
w AS (SELECT ps2.cell, coalesce(pn.p_nat, 0) / ps2.p_smp AS raw, ps2.k FROM ps2 LEFT JOIN pn USING (cell)),
wn AS (SELECT cell, raw / (sum(raw * k) OVER () / sum(k) OVER ()) AS weight FROM w)
SELECT row_idx, label, fraud_score, round(weight, 6) AS sample_weight FROM smp JOIN wn USING (cell)"""


ORACLES["stratified_sample"] = stratified_sql(100, 0.2, 3)

ORACLES["features_json"] = f"""
WITH st AS ({stratified_sql(100, 0.2, 3)})
SELECT row_idx, to_json(struct_pack(row_idx := row_idx, sample_weight := sample_weight))::VARCHAR AS features_json
FROM st"""


def class_fraction_sql(n: int, fraction: float, seed: int) -> str:
    """Class-fraction resample by its definition: negatives are the smallest
    hashes (seed + 1); positives the smallest hashes (seed) when there are
    enough of them, else draws with replacement d = 0..n_pos-1 picking the
    positive of rank int(md5(seed:d:d)[:13], 16) mod P in key order."""
    target = int(round(n * fraction))
    return f"""
WITH {ACT},
c AS (SELECT CAST(sum(label) AS BIGINT) AS p, CAST(count(*) - sum(label) AS BIGINT) AS q FROM act),
k AS (SELECT least({target}, 8 * p) AS n_pos, least({n} - least({target}, 8 * p), q) AS n_neg, p FROM c),
neg AS (SELECT row_idx, CAST(0 AS BIGINT) AS draw, label FROM (
          SELECT *, row_number() OVER (ORDER BY {md5_order(seed + 1, 'row_idx')}) AS r FROM act WHERE label = 0)
        WHERE r <= (SELECT n_neg FROM k)),
pos_plain AS (SELECT row_idx, CAST(0 AS BIGINT) AS draw, label FROM (
          SELECT *, row_number() OVER (ORDER BY {md5_order(seed, 'row_idx')}) AS r FROM act WHERE label = 1)
        WHERE r <= (SELECT n_pos FROM k) AND (SELECT n_pos <= p FROM k)),
pidx AS (SELECT row_idx, label, row_number() OVER (ORDER BY row_idx) - 1 AS pi FROM act WHERE label = 1),
draws AS (SELECT d AS draw, (('0x' || substr(md5('{seed}:d:' || CAST(d AS VARCHAR)), 1, 13))::BIGINT) % (SELECT p FROM k) AS pi
          FROM range(0, (SELECT n_pos FROM k)) t(d) WHERE (SELECT n_pos > p FROM k)),
pos_draw AS (SELECT pidx.row_idx, draws.draw, pidx.label FROM draws JOIN pidx USING (pi))
SELECT * FROM neg UNION ALL SELECT * FROM pos_plain UNION ALL SELECT * FROM pos_draw"""


ORACLES["class_fraction_resample"] = class_fraction_sql(200, 0.3, 5)

_HOLD = f"hold AS (SELECT * FROM act0 ORDER BY {md5_order(5, 'row_idx')} LIMIT 100)"
_POOL = f"""{ACT.replace('act AS (', 'act0 AS (', 1)}, {_HOLD},
act AS (SELECT * FROM act0 WHERE row_idx NOT IN (SELECT row_idx FROM hold))"""
ORACLES["load_pairs"] = f"""
SELECT 'train' AS part, row_idx, draw, label FROM ({class_fraction_sql(200, 0.3, 5).replace(ACT, _POOL)})
UNION ALL (WITH {ACT.replace('act AS (', 'act0 AS (', 1)}, {_HOLD}
  SELECT 'holdout', row_idx, CAST(0 AS BIGINT), label FROM hold)"""

ORACLES["stream_causal_features"] = ORACLES["causal_features"]

ORACLES["stream_journal"] = """
WITH j AS (SELECT doc_id AS row_idx, text AS summary, CAST(0 AS BIGINT) AS seq FROM documents
           UNION ALL SELECT doc_id, text || ' (rerun)', 1 FROM documents WHERE lang = 'de')
SELECT row_idx, seq, md5(summary) AS summary_md5 FROM j
QUALIFY row_number() OVER (PARTITION BY row_idx ORDER BY seq DESC) = 1"""

ORACLES["stream_step_metrics"] = f"""
SELECT turn AS step, round(avg(-length(text) / 1000.0::DOUBLE), 6) AS mean_reward,
       round(avg((conv_id % 7) / 8.0::DOUBLE), 6) AS mean_mse,
       round(avg(length({STRIP.format(x='text')})), 6) AS mean_explanation_chars, count(*) AS n
FROM conversations GROUP BY turn"""

ORACLES["tail_step_metrics"] = ORACLES["stream_step_metrics"]
ORACLES["tail_journal"] = ORACLES["stream_journal"]

ORACLES["spectrum_energy"] = f"""
WITH {ACT}, {RECON},
v AS (SELECT row_idx, 'gold' AS vectors, g AS x FROM recon UNION ALL SELECT row_idx, 'reconstructed', p FROM recon),
e AS (SELECT vectors, row_idx, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS a FROM v),
g AS (SELECT p.vectors, p.i, q.i AS j, sum(p.a * q.a) AS s FROM e p JOIN e q USING (vectors, row_idx) GROUP BY ALL)
SELECT vectors, (SELECT count(*) FROM recon) AS n, CAST(max(i) AS BIGINT) AS dims,
       round(sum(s) FILTER (WHERE i = j), 4) AS energy, round(sum(s * s), 2) AS energy_squared
FROM g GROUP BY vectors"""

ORACLES["render_by_source"] = f"""
SELECT 'sparkov' AS dataset_source, txn_id, rendered FROM ({ORACLES['render_card_present']})
UNION ALL SELECT 'ieee-fraud-detection', txn_id, rendered FROM ({ORACLES['render_ecom']})"""


HOT = """hot AS (SELECT * REPLACE (CASE WHEN txn_id % 3 = 0 THEN -1 ELSE card_id END AS card_id) FROM txn)"""

ORACLES["causal_features_hot_card"] = f"""
WITH {TXN}, {HOT}, {causal_cte('hot')}
SELECT txn_id, card_id, ts_sec, velocity_1h, velocity_24h,
       round(amt_zscore, 6) AS amt_zscore, card_tenure_days
FROM feat"""


_STEADY = """steady AS (SELECT * REPLACE (CASE WHEN card_id = -1 THEN 10002.5
  + CASE WHEN txn_id % 7 = 0 THEN 0.0009765625 ELSE 0.0 END + CASE WHEN txn_id % 97 = 0 THEN 10.0 ELSE 0.0 END
  ELSE 25.0 END::DOUBLE AS amt) FROM hot)"""

ORACLES["causal_features_steady_card"] = f"""
WITH {TXN}, {HOT}, {_STEADY}, {causal_cte('steady')}
SELECT strategy, txn_id, velocity_1h, velocity_24h, round(amt_zscore, 2) AS amt_zscore
FROM feat CROSS JOIN (VALUES ('window'), ('skew')) s(strategy)"""

ORACLES["fve_null_slice"] = f"""
WITH {ACT}, {RECON}, {NRM}, {ROWMSE},
nrm2 AS (SELECT * REPLACE (CASE WHEN label = 1 THEN '1' ELSE 'none' END AS label) FROM nrm
         UNION ALL SELECT * REPLACE ('all' AS label) FROM nrm),
{fve_sql('label').replace('FROM nrm', 'FROM nrm2')}
SELECT path, CASE WHEN slice = '1' THEN slice END AS slice, n, round(num, 6) AS mse_nrm,
       round(CASE WHEN den <> 0 THEN 1 - num / den END, 6) AS fve_nrm
FROM agg CROSS JOIN (VALUES ('narrow'), ('wide')) p(path)"""


def _prompt_sql() -> str:
    from txnlens.functions.render import USER_TEMPLATE
    tmpl = USER_TEMPLATE.replace("'", "''")
    nums = list(_NUM_EXPR)
    logit = " + ".join(f"a.{c} * w.{c}" for c in nums)
    return f"""
WITH {PREP},
applied AS (SELECT txn_id, train_split, is_fraud, {', '.join(_scaled_raw(c, e) for c, e in _NUM_EXPR.items())}
            FROM clipped),
w AS (SELECT {', '.join(f"corr({c}, CAST(is_fraud AS DOUBLE)) AS {c}" for c in nums)}
      FROM applied WHERE train_split = 'train'),
longa AS ({' UNION ALL '.join(f"SELECT a.txn_id, '{c}' AS name, a.{c} * w.{c} AS v FROM applied a, w" for c in nums)}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY txn_id ORDER BY abs(v) DESC, v DESC, name DESC) AS r
           FROM longa WHERE v IS NOT NULL AND NOT isnan(v)),
att AS (SELECT txn_id, string_agg(printf('  %s: %+.3f', name, v), chr(10) ORDER BY r) AS attributions
        FROM ranked WHERE r <= 8 GROUP BY txn_id),
sc AS (SELECT a.txn_id, 1.0 / (1.0 + exp(-({logit}))) AS fraud_score FROM applied a, w),
cp AS (SELECT p.txn_id, p.merchant, p.category, p.amt, p.hour_of_day, p.day_of_week, p.velocity_1h,
              p.velocity_24h, p.amt_zscore, p.card_tenure_days, CAST(NULL AS DOUBLE) AS geo_distance_km,
              CAST(NULL AS DOUBLE) AS age_at_txn, sc.fraud_score
       FROM prep p JOIN sc USING (txn_id)),
rd AS (SELECT txn_id, fraud_score, {RENDER_CP_SQL} AS rendered FROM cp)
SELECT rd.txn_id, printf('{tmpl}', printf('%.3f', coalesce(rd.fraud_score, 0.0)), rd.rendered,
                         coalesce(att.attributions, '(attributions not available)')) AS prompt
FROM rd LEFT JOIN att USING (txn_id)"""


ORACLES["prompt_text"] = _prompt_sql()

ORACLES["component_probes"] = f"""
WITH {ACT},
longa AS (SELECT row_idx, unnest(generate_series(0, len(activation_vector) - 1)) AS component, unnest(activation_vector)::DOUBLE AS x,
                 label::DOUBLE AS label, fraud_score, CASE WHEN row_idx % 3 <> 0 THEN fraud_score END AS thinned FROM act),
byt AS (SELECT row_idx % 5 = 0 AS held, component, x, u.feature, u.y
        FROM longa, LATERAL (VALUES ('label', label), ('fraud_score', fraud_score), ('thinned', thinned)) u(feature, y) WHERE u.y IS NOT NULL),
fit AS (SELECT feature, component, count(*) AS n_train, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2_train
        FROM byt WHERE NOT held GROUP BY ALL),
test AS (SELECT feature, component, count(*) AS n_test, 1 - sum((y - intercept - slope * x) ** 2) / (var_pop(y) * count(*)) AS r2_test
         FROM byt JOIN fit USING (feature, component) WHERE held GROUP BY ALL)
SELECT feature, CAST(component AS INTEGER) AS component, n_train, n_test, round(slope, 6) AS slope, round(intercept, 6) AS intercept,
       round(r2_train, 6) AS r2_train, round(r2_test, 6) AS r2_test
FROM fit JOIN test USING (feature, component)"""

ORACLES["csv_ecom"] = """
SELECT o_orderkey AS TransactionID, CAST(o_orderstatus = 'P' AS BIGINT) AS is_fraud, o_totalprice AS TransactionAmt,
       substr(o_orderpriority, 3, 1) AS ProductCD, o_custkey AS card1, lower(o_orderpriority) AS card4,
       CASE WHEN o_orderstatus = 'F' THEN 'debit' END AS card6, CAST(o_orderkey % 7 AS DOUBLE) AS addr1, CAST(NULL AS DOUBLE) AS addr2,
       CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice / 8 END AS dist1, CASE WHEN o_orderkey % 2 = 0 THEN 'gmail.com' END AS P_emaildomain,
       'a "quoted", b ' || o_orderkey AS R_emaildomain, CASE WHEN o_orderkey % 3 <> 2 THEN 'mobile' END AS DeviceType,
       CASE WHEN o_orderkey % 3 <> 2 THEN 'dev ' || o_orderkey END AS DeviceInfo, epoch_us(o_orderdate) // 1000000 AS ts_sec,
       'ieee-fraud-detection' AS dataset_source, hour(o_orderdate) AS hour_of_day, isodow(o_orderdate) - 1 AS day_of_week
FROM orders"""

ORACLES["csv_card_present"] = f"""
WITH {TXN}
SELECT txn_id, '4' || card_id AS cc_num, merchant, category, amt, CASE WHEN txn_id % 2 = 0 THEN 'F' END AS gender,
       lpad(CAST(card_id AS VARCHAR), 5, '0') AS zip, 25.25 + CAST(card_id * 7 % 23 AS DOUBLE) AS lat, -119.5 + CAST(card_id * 11 % 50 AS DOUBLE) AS long,
       25.25 + CAST(card_id * 7 % 23 AS DOUBLE) + CAST(txn_id % 21 - 10 AS DOUBLE) / 4 AS merch_lat,
       -119.5 + CAST(card_id * 11 % 50 AS DOUBLE) + CAST(txn_id * 3 % 41 - 20 AS DOUBLE) / 2 AS merch_long, ts_sec,
       CAST(is_fraud AS BIGINT) AS is_fraud, hour_of_day, day_of_week
FROM txn"""

ORACLES["committed_splits"] = """
SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 8 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice,
       CASE WHEN o_orderkey % 10 = 8 THEN 'val' ELSE 'test' END AS train_split
FROM orders WHERE o_orderkey % 10 >= 8"""
