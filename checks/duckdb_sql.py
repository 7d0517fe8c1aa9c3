"""DuckDB SQL for each query that SQL can express over the given tables."""

from __future__ import annotations

import math

from spendtrace import contract as C
from spendtrace.operators import daily as D
from spendtrace.operators import learn as L
from spendtrace.operators import snapshot as SN
from spendtrace.operators import trajectory as TJ
from spendtrace.operators import trees as TR
from checks.catalog import BATCH_CUT, HALF, TIMELINE_CUSTOMER

F9 = C.FEATURES
F10 = C.MODEL_INPUTS

K = "cast(json_extract_string(props,'$.k') as int)"

EPISODES = f"""
 select user_id as customer_id, event_id as transaction_id, ts as timestamp,
  case when marked then round(value * (k + 50) / 25, 2) else value end as amount,
  event_type as merchant_category,
  case when marked and k < 80 then 'SHARED_' || cast(event_id % 20 as varchar)
   else 'DEV_' || cast(user_id as varchar) || case when k < 85 then '_A' else '_B' end
   end as device_id,
  case when marked and k % 2 = 0 then 'ABROAD_' || cast(k % 5 as varchar)
   else 'CITY_' || cast(user_id % 10 as varchar) end as location,
  cast(case when marked then 2 + k % 4 when k % 10 = 0 then 1 else 0 end as int)
   as failed_logins_24h,
  case when marked then 1 else 0 end as is_fraud
 from (select *, {K} as k, user_id % 8 = 0 and day(ts) between 14 and 17 as marked from events)
"""

HOT = f"""
 select user_id as customer_id, event_id as transaction_id, ts as timestamp, value as amount,
  event_type as merchant_category, 'DEV_' || cast({K} as varchar) as device_id,
  'LOC_' || cast({K} % 15 as varchar) as location, 0 as failed_logins_24h,
  case when value >= 120 and event_type in ('error','purchase') then 1 else 0 end as is_fraud
 from events
"""

SKEWED = f"""
 select case when customer_id % 3 = 0 then 0 else customer_id end as customer_id,
  * exclude (customer_id) from ({HOT})
"""

SKEWED_NULL = f"""
 select nullif(customer_id, 0) as customer_id, * exclude (customer_id) from ({SKEWED})
"""

ORDERS = """
 select o.o_custkey as customer_id, o.o_orderkey as transaction_id, o.o_orderdate as timestamp,
  o.o_totalprice as amount, o.o_orderpriority as merchant_category,
  'SUP_' || cast(m.s as varchar) as device_id, n.n_name as location, r.r_name as home_region,
  0 as failed_logins_24h,
  case when o.o_orderstatus = 'F' and o.o_totalprice > 450000 then 1 else 0 end as is_fraud
 from orders o join customer c on o.o_custkey = c.c_custkey
 left join (select l_orderkey, min(l_suppkey) as s from lineitem group by l_orderkey) m
  on m.l_orderkey = o.o_orderkey
 join nation n on n.n_nationkey = c.c_nationkey
 join region r on r.r_regionkey = n.n_regionkey
"""

BATCH = f"""
 select case when {K} = 7 then null else cast(user_id as varchar) end as customer_id,
  event_id as transaction_id, ts as timestamp,
  case when {K} % 25 = 0 then -value when {K} % 25 = 1 then null else value end as amount,
  event_type as merchant_category,
  case when {K} % 3 = 0 then null when {K} % 3 = 1 then ''
   else 'DEV_' || cast(user_id as varchar) || '_A' end as device_id,
  case when {K} % 4 = 0 then null else 'CITY_' || cast(user_id % 10 as varchar) end as location,
  case when {K} % 5 = 0 then null when {K} % 50 = 1 then -1 else {K} % 3 end
   as failed_logins_24h
 from events
"""

EPISODE_HOME = "location like 'CITY_%'"
HOT_HOME = "cast(substr(location, 5) as int) < 10"
ORDERS_HOME = "home_region = 'ASIA'"


def clip(x: str, low: float, high: float) -> str:
    return f"greatest(least({x}, {high}::double), {low}::double)"


def features(log: str, home: str) -> str:
    """CTEs txn, st and f: the log, its running state and the features."""
    own = "(partition by customer_id order by timestamp, transaction_id"
    mean = "case when n > 0 then pm else amount end"
    std = (f"greatest(case when n > 1 then ps else greatest(({mean}) * 0.3::double, 1::double)"
           f" end, ({mean}) * 0.1::double, 1::double)")
    return f"""
with txn as ({log}),
st as (select *, row_number() over {own}) - 1 as n,
 avg(amount) over {own} rows between unbounded preceding and 1 preceding) as pm,
 stddev_pop(amount) over {own} rows between unbounded preceding and 1 preceding) as ps,
 count(*) over (partition by customer_id order by epoch_us(timestamp)
  range between unbounded preceding and 3600000001 preceding) as older,
 row_number() over (partition by customer_id, hour(timestamp)
  order by timestamp, transaction_id) - 1 as hs,
 row_number() over (partition by customer_id, merchant_category
  order by timestamp, transaction_id) - 1 as cs,
 row_number() over (partition by customer_id, device_id
  order by timestamp, transaction_id) as dn,
 row_number() over (partition by customer_id, location
  order by timestamp, transaction_id) as ln from txn),
f as (select * exclude (failed_logins_24h),
 {clip(f"(amount - ({mean})) / ({std})", -10, 10)} as amount_zscore,
 case when n > 0 and hs / n < 0.05::double then 1 else 0 end as hour_is_unusual,
 case when dn = 1 then 1 else 0 end as is_new_device,
 case when ln = 1 then 1 else 0 end as is_new_location,
 case when {home} then 0 else 1 end as is_foreign_location,
 failed_logins_24h,
 case when n = 0 or cs / n < 0.05::double then 1 else 0 end as category_is_unusual,
 cast(n - older as int) as txn_velocity_1h,
 {clip(f"amount / greatest({mean}, 1e-6::double) * 100", 0, 1000)} as amount_pct_of_avg
 from st)"""


EPISODE_F = features(EPISODES, EPISODE_HOME)
ORDERS_F = features(ORDERS, ORDERS_HOME)
HOT_F = features(HOT, HOT_HOME)
SKEWED_F = features(SKEWED, HOT_HOME)

OWN = "partition by customer_id order by timestamp, transaction_id"


def risk() -> str:
    """CTE r: features plus the fixed stage-1 risk score."""
    parts = []
    for f, w in zip(F9, L.FIXED_TRAJECTORY_WEIGHTS):
        mean = (f"case when n = 0 then 0 else (sum({f}::double) over w10"
                f" + (10 - least(n, 10)) * first_value({f}::double) over w10) / 10 end")
        parts.append(f"{w}::double * ({mean})")
    return f""",
r as (select *, round(100 / (1 + exp(-({L.FIXED_TRAJECTORY_INTERCEPT} + {' + '.join(parts)}))), 2)
 as risk_score from f
 window w10 as ({OWN} rows between 10 preceding and 1 preceding)),
j as (select *, (('0x' || substr(md5(transaction_id::varchar), 1, 8))::bigint % 1000) < 200
 as is_test from r where n >= 10)"""


def scaler() -> str:
    stats = ", ".join(
        f"avg({c}) as m_{c}, case when stddev_pop({c}) = 0 then 1 else stddev_pop({c}) end as s_{c}"
        for c in F10)
    return f""",
tr as (select * from j where not is_test),
sc as (select {stats} from tr)"""


RISK = EPISODE_F + risk() + scaler()


def x(c: str, limited: bool = True) -> str:
    scaled = f"(({c}) - m_{c}) / s_{c}"
    return clip(scaled, -6, 6) if limited else scaled


LOGIT = f"({L.FIXED_TRANSACTION_INTERCEPT}::double + " + " + ".join(
    f"{w}::double * {x(c)}" for c, w in zip(F10, L.FIXED_TRANSACTION_WEIGHTS)) + ")"
PROBABILITY = f"(1 / (1 + exp(-{LOGIT})))"
SERVED = f"least({PROBABILITY}, 0.999::double)"

# CTE p: every row with its served probability
SCORED = RISK + f""",
p as (select r.*, {LOGIT} as logit, {SERVED} as prob from r, sc)"""

LEVEL = ("case when prob * 100 < 25 then 'Low Risk' when prob * 100 < 50 then 'Medium Risk'"
         " when prob * 100 < 80 then 'High Risk' else 'Critical Risk' end")

BG = f""",
bg as (select transaction_id, {', '.join(f'{x(c, False)} as {c}' for c in F10)}
 from tr, sc order by md5(transaction_id::varchar), transaction_id limit 200)"""


def reasons() -> str:
    """CTEs e (contribution per gated row and input) and top (the reasons)."""
    blogit = f"{L.FIXED_TRANSACTION_INTERCEPT}::double + " + " + ".join(
        f"{w}::double * {c}" for c, w in zip(F10, L.FIXED_TRANSACTION_WEIGHTS))
    bg_columns = ", ".join(f"bg.{c} as b_{c}" for c in F10)
    x_columns = ", ".join(f"{x(c)} as x_{c}" for c in F10)
    contributions = ", ".join(
        f"avg({w}::double * (x_{c} - b_{c}) * slope) as c_{i}"
        for i, (c, w) in enumerate(zip(F10, L.FIXED_TRANSACTION_WEIGHTS)))
    rows = " union all ".join(
        f"select transaction_id, {i} as position, '{c}' as feature,"
        f" '{C.DISPLAY_NAMES[c]}' as display_name, c_{i} as value from wide"
        for i, c in enumerate(F10))
    return BG + f""",
bl as (select *, {blogit} as bl from bg),
gated as (select transaction_id, logit, {x_columns} from p, sc where prob >= 0.05),
pairs as (select gated.*, {bg_columns.replace('bg.', 'bl.')},
 case when abs(logit - bl) > 1e-9
  then (1/(1+exp(-logit)) - 1/(1+exp(-bl))) / (logit - bl)
  else 1/(1+exp(-bl)) * (1 - 1/(1+exp(-bl))) end as slope from gated, bl),
wide as (select transaction_id, {contributions} from pairs group by transaction_id),
e as ({rows}),
top as (select * from (select *, row_number() over (partition by transaction_id
 order by value desc, position) as rank from e where value > 0) where rank <= 4)"""


REASONS = SCORED + reasons()


def rounded(columns, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) as {c}" for c in columns)


FEATURE_OUT = ", ".join(
    f"round({c}, 6) as {c}" if c in ("amount_zscore", "amount_pct_of_avg") else c for c in F9)


def unpivot(source: str, template: str, columns) -> str:
    return " union all ".join(template.format(c=c, source=source) for c in columns)


def sequences(cte: str) -> str:
    steps = ", ".join(
        f"round(b.{c}::double, 6) as {c}" if c in ("amount_zscore", "amount_pct_of_avg")
        else f"b.{c}::double as {c}" for c in F9)
    return cte + f"""
select a.customer_id, a.transaction_id, a.is_fraud as label,
 cast(b.n - a.n + 10 as int) as step, {steps}
from f a join f b on a.customer_id = b.customer_id and b.n between a.n - 10 and a.n - 1
where a.n >= 10"""


def profile(cte: str, table: str = "f", where: str = "true") -> str:
    rows = unpivot(table, "select customer_id, '{c}' as feature, {c}::double as v from {source}"
                   f" where {where}", F9)
    return cte + f"""
select customer_id, count(*) as n_rows, feature, round(avg(v), 6) as mean,
 round(coalesce(stddev_samp(v), 1), 6) as std
from ({rows}) group by customer_id, feature"""


def similarity_cte(source: str = "f") -> str:
    own = f"over ({OWN} rows between unbounded preceding and 1 preceding)"
    stats = ", ".join(
        f"case when n > 0 then avg({c}) {own} else 0 end as pm_{c},"
        f" case when n > 1 then stddev_pop({c}) {own} else 1 end as ps_{c}" for c in F9)
    z = " + ".join(
        f"abs(({c} - pm_{c}) / case when ps_{c} <= 1e-6::double then 1 else ps_{c} end)"
        for c in F9)
    return f""",
prof as (select *, {stats} from {source}),
sim as (select *, round(100 * exp(-az / 2.9::double), 2) as similarity_pct
 from (select *, ({z}) / 9 as az from prof))"""


def rings(log: str, minimum: int) -> str:
    return f"""
with txn as ({log}),
c as (select device_id, customer_id, count(*) as n_txn from txn
 where device_id is not null group by all)
select 'shared_device' as ring_type, device_id as identifier,
 count(*) as n_customers, sum(n_txn)::bigint as transaction_count
from c group by device_id having count(*) >= {minimum}"""


LEVELS = ("(values ('Critical Risk', 0), ('High Risk', 1), ('Medium Risk', 2), ('Low Risk', 3))"
          " lv(alert_level, severity_order)")


def summary(cte: str, source: str) -> str:
    return cte + f"""
select lv.alert_level, lv.severity_order::int as severity_order, count(s.alert_level) as n
from {LEVELS} left join (select {LEVEL} as alert_level from {source}) s
 on s.alert_level = lv.alert_level
group by all"""


def violations() -> str:
    rules = [
        ("customer_id is missing", "customer_id is null or trim(customer_id) = ''"),
        ("amount is missing", "amount is null"),
        ("amount must be positive", "amount <= 0"),
        ("merchant_category is missing", "merchant_category is null"),
        ("failed_logins_24h must not be negative", "failed_logins_24h < 0"),
    ]
    listed = ", ".join(f"case when {c} then '{n}' end" for n, c in rules)
    return f"""
with b as ({BATCH}),
v as (select *, concat_ws('; ', {listed}) as vs from b)"""


SIMILARITY = EPISODE_F + similarity_cte()
SCORED_SIM = SCORED + similarity_cte("p")

TEST = SCORED + f""",
t as (select {PROBABILITY} as prob, is_fraud from j, sc where is_test),
cm as (select count(*) filter (is_fraud <> 1 and prob < 0.5) as true_negative,
 count(*) filter (is_fraud <> 1 and prob >= 0.5) as false_positive,
 count(*) filter (is_fraud = 1 and prob < 0.5) as false_negative,
 count(*) filter (is_fraud = 1 and prob >= 0.5) as true_positive from t)"""


def summary_stats() -> str:
    rows = unpivot("f", "select '{c}' as feature, {c}::double as v from {source}",
                   [*F9, "is_fraud"])
    return EPISODE_F + f"""
select feature, count(v) as count, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as std,
 round(min(v), 6) as min, round(quantile_cont(v, 0.25), 6) as q25,
 round(quantile_cont(v, 0.5), 6) as q50, round(quantile_cont(v, 0.75), 6) as q75,
 round(max(v), 6) as max from ({rows}) group by feature"""


def summary_by_buckets() -> str:
    """Quartiles by buckets of relative width over all rows at once, beside the exact ones."""
    rows = unpivot("f", "select '{c}' as feature, {c}::double as v from {source}", [*F9, "is_fraud"])
    width, near = f"{D.WIDTH!r}::double", f"{1 - D.RELATIVE_ERROR!r}::double"
    ranks = [(f"q{int(share * 100)}", share) for share in (0.25, 0.5, 0.75)]
    at = ", ".join(
        f"max(shown) filter (upto - n <= {f}((total - 1) * {share}::double)"
        f" and {f}((total - 1) * {share}::double) < upto) as {q}_{f}"
        for q, share in ranks for f in ("floor", "ceil"))
    between = ", ".join(
        f"round({q}_floor + ({q}_ceil - {q}_floor) * ((total - 1) * {share}::double"
        f" - floor((total - 1) * {share}::double)), 6) as {q}" for q, share in ranks)
    return EPISODE_F + f""",
vs as ({rows}),
bk as (select feature, v, case when abs(v) < {D.LEAST_VALUE!r}::double then 0
  else sign(v) * ({D.SHIFT} + ceil(ln(abs(v)) / {width})) end as b from vs),
ct as (select feature, b, count(*) as n, min(v) as low, max(v) as high from bk group by feature, b),
pl as (select feature, n, sum(n) over (partition by feature) as total,
  sum(n) over (partition by feature order by b) as upto,
  greatest(low, least(high, case when b = 0 then 0
    else sign(b) * exp((abs(b) - {D.SHIFT}) * {width}) * {near} end)) as shown from ct),
qt as (select feature, total, {at} from pl group by feature, total),
ex as (select feature, count(v) as count, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as std,
  round(min(v), 6) as min, round(max(v), 6) as max,
  {", ".join(f"round(quantile_cont(v, {share}), 6) as {q}_exact" for q, share in ranks)}
  from vs group by feature)
select ex.*, {between} from ex join qt using (feature)"""


def stats_long(cte: str, source: str, columns, suffix: str = "") -> str:
    rows = unpivot(source, "select '{c}' as feature, {c}::double as v from {source}", columns)
    return cte + suffix + f"""
select feature, round(avg(v), 6) as mean,
 round(case when stddev_pop(v) = 0 then 1 else stddev_pop(v) end, 6) as std
from ({rows}) group by feature"""


def latest() -> str:
    steps = ", ".join(
        f"round(b.{c}::double, 6) as {c}" if c in ("amount_zscore", "amount_pct_of_avg")
        else f"b.{c}::double as {c}" for c in F9)
    return ORDERS_F + f""",
c as (select customer_id, count(*) as cnt from f group by customer_id),
s as (select customer_id, cnt, i from c, range(10) t(i))
select s.customer_id, cast(s.i as int) as step, {steps}
from s join f b on b.customer_id = s.customer_id and b.n = greatest(cnt - 10 + i, 0)"""


def _tree_logit(value, trees=TR.FIXED_TREES, intercept=TR.FIXED_TREE_INTERCEPT) -> str:
    """The fixed trees in SQL; `value` names the scaled input of a number."""
    def of(tree, at):
        if len(tree[at]) == 1:
            return f"{tree[at][0]}::double"
        i, threshold, left, right = tree[at]
        return f"case when {value(i)} <= {threshold}::double then {of(tree, left)} else {of(tree, right)} end"
    return f"{intercept}::double + " + " + ".join(of(t, 0) for t in trees)


def _coalitions() -> str:
    """Shapley values by definition: every set of inputs from the row, the others from a background row."""
    used = sorted({int(n[0]) for t in TR.FIXED_TREES for n in t if len(n) > 1})
    m = len(used)
    mixed = _tree_logit(lambda i: f"(case when (s >> {used.index(i)}) & 1 = 1 then x{i} else b{i} end)")
    own = ", ".join(f"{x(F10[i])} as x{i}" for i in used)
    base = ", ".join(f"{F10[i]} as b{i}" for i in used)
    weights = ", ".join(f"{math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m)}::double"
                        for k in range(m))
    values = ", ".join(
        f"sum(case when (s >> {k}) & 1 = 1 then w[bit_count(s)] else -w[bit_count(s) + 1] end * f) as v{i}"
        for k, i in enumerate(used))
    parts = ", ".join(f"round(avg(v{i} * slope) + 1e-9, 6) as by_{F10[i]}" if i in used
                      else f"round(0::double + 1e-9, 6) as by_{F10[i]}" for i in range(len(F10)))
    whole = (1 << m) - 1
    return f""",
asked as (select * from (select transaction_id, {own}, {_tree_logit(lambda i: x(F10[i]))} as logit
  from j, sc where is_test) where least(1 / (1 + exp(-logit)), 0.999::double) >= 0.05),
sets as (select unnest(range({whole + 1}))::int as s),
fs as (select a.transaction_id, b.transaction_id as background, s, {mixed} as f
  from asked a, (select transaction_id, {base} from bg) b, sets),
v as (select transaction_id, background, {values},
  max(f) filter (s = {whole}) as fx, max(f) filter (s = 0) as fb
  from (select *, [{weights}] as w from fs) group by transaction_id, background),
z as (select *, case when abs(fx - fb) > 1e-9 then (1 / (1 + exp(-fx)) - 1 / (1 + exp(-fb))) / (fx - fb)
  else 1 / (1 + exp(-fb)) * (1 - 1 / (1 + exp(-fb))) end as slope from v)
select transaction_id, round(least(1 / (1 + exp(-any_value(fx))), 0.999::double) + 1e-9, 6) as probability, {parts}
from z group by transaction_id"""


def report() -> str:
    values = [
        ("Alert", 1, "Alert Level", "alert_level", None),
        ("Transaction Details", 1, "Transaction ID", "transaction_id::varchar", None),
        ("Transaction Details", 2, "Customer ID", "customer_id::varchar", None),
        ("Transaction Details", 3, "Timestamp", "strftime(timestamp, '%Y-%m-%d %H:%M:%S')", None),
        ("Transaction Details", 4, "Amount", "'Rs. ' || format('{:,.2f}', amount)", None),
        ("Transaction Details", 5, "Merchant Category",
         "replace(merchant_category, '_', ' ')", None),
        ("Transaction Details", 6, "Device ID", "device_id", None),
        ("Transaction Details", 7, "Location", "location", None),
        ("Transaction Details", 8, "Failed Logins (24h)", "failed_logins_24h::varchar", None),
        ("Risk Assessment", 1, "Risk Score", "format('{:.1f}', risk_score) || ' / 100'", 0),
        ("Risk Assessment", 2, "Fraud Probability",
         "format('{:.1f}', fraud_probability) || '%'", 1),
        ("Risk Assessment", 3, "Behavioral Similarity",
         "format('{:.1f}', similarity_pct) || '%'", 2),
        ("Risk Assessment", 4, "Deviation", "format('{:.1f}', deviation_pct) || '%'", 3),
    ]
    meanings = list(C.METRIC_MEANINGS.values())
    parts = []
    for section, position, label, value, meaning in values:
        text = "null::varchar" if meaning is None else "'" + meanings[meaning].replace("'", "''") + "'"
        parts.append(f"select transaction_id, '{section}' as section, {position} as position,"
                     f" '{label}' as label, {value} as value, {text} as meaning from s")
    parts.append("select transaction_id, 'Reasons', rank::int, display_name,"
                 " format('{:+.3f}', value), null from top")
    parts.append(f"select transaction_id, 'Reasons', 1, '{C.NO_REASONS_SENTENCE}', null, null"
                 " from s where transaction_id not in (select transaction_id from top)")
    return REASONS + similarity_cte("p") + f""",
s as (select *, {LEVEL} as alert_level, round(prob * 100, 2) as fraud_probability,
 round(100 - similarity_pct, 2) as deviation_pct from sim)
""" + " union all ".join(parts)


def all_sql() -> dict[str, str]:
    out = {}
    out["txn_canonical"] = f"""
select customer_id::varchar as customer_id, transaction_id::varchar as transaction_id,
 cast(cast(timestamp as varchar) as timestamp) as timestamp, amount, merchant_category,
 device_id, location, failed_logins_24h, is_fraud from ({EPISODES})"""
    out["contract_violations"] = violations() + """
select transaction_id, vs as violations from v where vs <> ''"""
    out["violation_counts"] = violations() + """
select violation, count(*) as n 
from (select unnest(string_split(vs, '; ')) as violation from v where vs <> '')
group by violation"""
    out["batch_defaults"] = violations() + """
select customer_id, transaction_id, timestamp, amount, merchant_category,
 coalesce(nullif(device_id, ''), 'DEV_' || customer_id || '_A') as device_id,
 coalesce(nullif(location, ''), 'Hyderabad') as location,
 coalesce(failed_logins_24h, 0) as failed_logins_24h from v where vs = ''"""
    out["generated_ids"] = f"""
select transaction_id, 'TXN_' || upper(substr(md5(customer_id::varchar || '|' ||
 transaction_id::varchar || '|' || merchant_category), 1, 10)) as generated_id from ({EPISODES})"""
    out["sequential_ids"] = f"""
select transaction_id, 'TXN_' || lpad((row_number() over (
 order by customer_id, timestamp, transaction_id) - 1)::varchar, 7, '0') as sequential_id
from ({HOT})"""
    out["new_device_flags"] = HOT_F + " select transaction_id, is_new_device from f"
    out["new_location_flags"] = HOT_F + " select transaction_id, is_new_location from f"
    for name, column, cte in [
            ("feat_amount_zscore", "round(amount_zscore, 6) as amount_zscore", EPISODE_F),
            ("feat_amount_pct", "round(amount_pct_of_avg, 6) as amount_pct_of_avg", EPISODE_F),
            ("feat_hour_unusual", "hour_is_unusual", EPISODE_F),
            ("feat_category_unusual", "category_is_unusual", EPISODE_F),
            ("feat_foreign_location", "is_foreign_location", ORDERS_F),
            ("feat_velocity_1h", "txn_velocity_1h", EPISODE_F),
            ("feat_velocity_1h_ties", "txn_velocity_1h", ORDERS_F)]:
        out[name] = cte + f" select transaction_id, {column} from f"
    out["failed_logins_24h_derived"] = f"""
select transaction_id, cast(count(*) filter (merchant_category = 'error') over (
 partition by customer_id order by epoch_us(timestamp)
 range between 86400000000 preceding and 1 preceding) as int) as failed_logins_24h
from ({HOT})"""
    for name, cte in [("point_features", EPISODE_F), ("point_features_orders", ORDERS_F),
                      ("point_features_hot", HOT_F), ("point_features_skewed", SKEWED_F)]:
        out[name] = cte + f" select customer_id, transaction_id, {FEATURE_OUT}, is_fraud from f"
    out["scores_skewed"] = SKEWED_F + risk() + similarity_cte("r") + """
select transaction_id, risk_score, similarity_pct, round(az, 6) as avg_z_deviation from sim"""
    out["scores_skewed_null_key"] = (
        features(SKEWED_NULL, HOT_HOME) + risk() + similarity_cte("r")) + f"""
select customer_id, transaction_id, {FEATURE_OUT}, risk_score, similarity_pct,
 round(az, 6) as avg_z_deviation from sim"""
    out["feature_summary"] = summary_stats()
    out["feature_summary_daily"] = summary_by_buckets()
    out["dataset_size"] = f"""
select count(*) as n_rows, count(distinct customer_id) as n_customers,
 round(avg(is_fraud) * 100, 3) as fraud_rate_pct from ({EPISODES})"""
    out["sequences_long"] = sequences(EPISODE_F)
    out["sequences_long_orders"] = sequences(ORDERS_F)
    out["sequence_label_rate"] = EPISODE_F + """
select count(*) as n_sequences, 10 as steps, 9 as features,
 round(avg(is_fraud) * 100, 2) as fraud_rate_pct from f where n >= 10"""
    out["latest_sequence_padded"] = latest()
    out["customer_profile"] = profile(EPISODE_F)
    out["profile_prefix"] = profile(ORDERS_F, where="n < 5")
    out["similarity"] = SIMILARITY + """
select transaction_id, similarity_pct, round(100 - similarity_pct, 2) as deviation_pct,
 round(az, 6) as avg_z_deviation from sim"""
    out["split_counts"] = RISK + """
select is_test, is_fraud, count(*) as n from j group by is_test, is_fraud"""
    out["scaler_stats"] = stats_long(RISK, "tr", F10)
    out["seq_scaler_stats"] = stats_long(RISK, "w", F9, f""",
w as (select b.* from tr a join f b on a.customer_id = b.customer_id
 and b.n between a.n - 10 and a.n - 1)""")
    out["class_weights"] = RISK + """
select sum(is_fraud)::bigint as n_pos, (count(*) - sum(is_fraud))::bigint as n_neg,
 round(greatest((count(*) - sum(is_fraud)) / greatest(sum(is_fraud), 1), 1), 6) as weight_pos
from tr"""
    out["background_sample"] = RISK + BG + f"""
select transaction_id, {rounded(F10)} from bg"""
    out["normalised_clipped"] = RISK + " select transaction_id, " + ", ".join(
        f"round({x(c)}, 6) as {c}" for c in F10) + " from r, sc"
    out["risk_scores_fixed"] = RISK + " select transaction_id, risk_score from r"
    out["handoff_join"] = RISK + f"""
select transaction_id, {FEATURE_OUT}, is_fraud, risk_score from j"""
    out["fraud_prob_fixed"] = SCORED + """
select transaction_id, round(prob * 100, 2) as fraud_probability from p"""
    out["alert_levels"] = SCORED + f"""
select transaction_id, {LEVEL} as alert_level,
 case when risk_score <= 25 then 'low' when risk_score <= 50 then 'medium'
  when risk_score <= 80 then 'high' else 'critical' end as risk_band from p"""
    out["alert_summary"] = summary(SCORED, "p")
    out["logit_contributions"] = SCORED + BG + f""",
bm as (select {', '.join(f'avg({c}) as b_{c}' for c in F10)} from bg)
select transaction_id, """ + ", ".join(
        f"round({w}::double * ({x(c)} - b_{c}), 6) as {c}"
        for c, w in zip(F10, L.FIXED_TRANSACTION_WEIGHTS)) + " from r, sc, bm"
    out["probability_contributions"] = REASONS + """
select transaction_id, position, round(value, 6) as contribution from e"""
    out["reasons_topk"] = REASONS + """
select transaction_id, rank::int as rank, feature, display_name,
 round(value, 6) as attribution from top"""
    out["reasons_display"] = REASONS + """
select transaction_id, cast(row_number() over (partition by transaction_id
 order by round(value, 4), display_name) as int) as position, display_name as name,
 round(value, 4) as value from top"""
    out["confusion"] = TEST + " select * from cm"
    out["prf1"] = TEST + """
select round(case when true_positive + false_positive > 0
  then true_positive / (true_positive + false_positive) else 0 end, 4) as precision,
 round(case when true_positive + false_negative > 0
  then true_positive / (true_positive + false_negative) else 0 end, 4) as recall,
 round(case when 2 * true_positive + false_positive + false_negative > 0
  then 2 * true_positive / (2 * true_positive + false_positive + false_negative)
  else 0 end, 4) as f1_score,
 true_negative + false_positive + false_negative + true_positive as test_set_size,
 round((true_positive + false_negative) * 100 /
  (true_negative + false_positive + false_negative + true_positive), 3) as fraud_rate_pct
from cm"""
    out["auc_roc"] = TEST + """,
rk as (select is_fraud, avg(i) over (partition by prob) as rank
 from (select *, row_number() over (order by prob) as i from t))
select round((sum(rank) filter (is_fraud = 1)
  - count(*) filter (is_fraud = 1) * (count(*) filter (is_fraud = 1) + 1) / 2)
 / count(*) filter (is_fraud = 1) / count(*) filter (is_fraud <> 1), 4) as auc_roc from rk"""
    out["auc_weekly"] = SCORED + f""",
t as (select strftime(date_trunc('week', timestamp), '%Y-%m-%d') as week, is_fraud, {PROBABILITY} as prob
 from j, sc where is_test),
bk as (select week, is_fraud, floor(least(greatest(case when prob >= 1 then {D.ODDS_LIMIT}::double
   else ln(prob / (1 - prob)) end, -{D.ODDS_LIMIT}::double), {D.ODDS_LIMIT}::double) * {D.ODDS_STEPS}) as b
 from t),
ct as (select week, b, count(*) filter (is_fraud = 1) as p, count(*) filter (is_fraud <> 1) as q
 from bk group by week, b),
cu as (select *, sum(q) over (partition by week order by b) - q as below from ct),
rk as (select week, is_fraud, avg(i) over (partition by week, prob) as rank
 from (select *, row_number() over (partition by week order by prob) as i from t)),
ex as (select week, (sum(rank) filter (is_fraud = 1)
  - count(*) filter (is_fraud = 1) * (count(*) filter (is_fraud = 1) + 1) / 2)
 / nullif(count(*) filter (is_fraud = 1), 0) / nullif(count(*) filter (is_fraud <> 1), 0) as auc
 from rk group by week)
select week, cast(sum(p) + sum(q) as bigint) as n,
 round(sum(p * (below + q / 2)) / nullif(sum(p) * sum(q), 0)::double, 6) as auc_roc,
 round(sum(p * q / 2) / nullif(sum(p) * sum(q), 0)::double, 6) as auc_error,
 round(any_value(auc), 6) as auc_exact
from cu join ex using (week) group by week"""
    names = ["intercept", *F10]
    out["trained_optimum"] = EPISODE_F + risk() + """
select unnest(range(11))::int as position, unnest([""" + ", ".join(f"'{n}'" for n in names) + """])
 as input, true as at_optimum, (select count(*) from j where not is_test) as n_rows"""
    out["boosted_attribution"] = EPISODE_F + risk() + """
select transaction_id, 10 as n_inputs, true as adds_up from j where is_test and is_fraud = 1"""
    logit = _tree_logit(lambda i: x(F10[i]))
    out["tree_models_round_trip"] = RISK + f""",
p as (select r.*, least(1 / (1 + exp(-({logit}))), 0.999::double) as prob from r, sc)""" + similarity_cte("p") + f"""
select transaction_id, risk_score, round(prob * 100, 2) as fraud_probability, similarity_pct,
 {LEVEL} as alert_level from sim"""
    def entry(i: int) -> str:  # padded in front with the earliest vector, all zeros without one
        step, f = divmod(i, len(F9))
        back = C.SEQUENCE_LENGTH - step
        return (f"case when n >= {back} then lag({F9[f]}::double, {back}) over w when n > 0"
                f" then first_value({F9[f]}::double) over w else 0 end")

    window = _tree_logit(entry, TJ.FIXED_WINDOW_TREES, TJ.FIXED_WINDOW_INTERCEPT)
    out["risk_scores_trees"] = EPISODE_F + f"""
select customer_id, transaction_id, n as n_prior, round(100 / (1 + exp(-({window}))), 2) as risk_score
from f window w as ({OWN})"""
    out["tree_attribution"] = RISK + BG + _coalitions()
    out["trained_held_out"] = EPISODE_F + risk() + """,
q as (select count(*) as n, count(*) filter (is_fraud = 1) as p from j where is_test)
select unnest(['trajectory', 'transaction']) as model, n as test_set_size,
 round(p * 100 / n, 3) as fraud_rate_pct, 0.5::double as threshold, p as n_fraud, true as ranks_well from q"""
    out["csv_log_round_trip"] = f"""
select customer_id::varchar as customer_id, transaction_id::varchar as transaction_id, timestamp, amount,
 merchant_category, device_id, location, failed_logins_24h::int as failed_logins_24h, is_fraud::int as is_fraud
from ({HOT})"""
    for name in ("feature_store_round_trip", "features_recomputed"):
        out[name] = EPISODE_F + (
            f" select customer_id, transaction_id, {FEATURE_OUT}, is_fraud from f")
    out["sequence_store_round_trip"] = EPISODE_F + """
select customer_id, transaction_id, 10 as steps, sum_v as velocity_sum, is_fraud as label from (
 select *, sum(txn_velocity_1h::double) over (partition by customer_id order by timestamp, transaction_id
  rows between 10 preceding and 1 preceding) as sum_v from f) where n >= 10"""
    out["batch_csv_mixed_headers"] = f"""
select transaction_id::varchar as transaction_id, customer_id, amount, merchant_category,
 nullif(device_id, '') as device_id, location from ({BATCH})"""
    unparsed = ("case when transaction_id % 7 = 0 then 'amount does not parse' end,"
                " case when transaction_id % 11 = 0 then 'failed_logins_24h does not parse' end")
    out["batch_unparsed_values"] = f"""
with b as (select * replace (case when transaction_id % 7 = 0 then null else amount end as amount,
  case when transaction_id % 11 = 0 then null else failed_logins_24h end as failed_logins_24h)
 from ({BATCH})),
v as (select transaction_id, concat_ws('; ',
 case when customer_id is null then 'customer_id is missing' end,
 case when amount is null then 'amount is missing' end,
 case when amount <= 0 then 'amount must be positive' end,
 case when failed_logins_24h < 0 then 'failed_logins_24h must not be negative' end, {unparsed})
 as violations from b)
select transaction_id::varchar as transaction_id, violations from v where violations <> ''"""
    message = "input is missing required columns: "
    out["missing_columns"] = " union all ".join(
        f"select '{t}' as table_name, '{(message + m).replace(chr(39), chr(39) * 2)}' as message,"
        f" count(*) as n_rows from {t}" for t, m in [
            ("events", "['merchant_category']"), ("orders", "['amount', 'merchant_category']"),
            ("customer", "['amount', 'customer_id', 'merchant_category']"),
            ("lineitem", "['amount', 'customer_id', 'merchant_category']")])
    out["models_round_trip"] = SCORED + """
select transaction_id, round(prob * 100, 2) as fraud_probability from p"""
    sums = ", ".join(f"round(sum({c}), 4) as sum_{c}" for c in F10)
    out["background_stored"] = RISK + BG + f"""
select (select count(*) from r) as n_rows, count(*)::int as n_background, {sums} from bg"""
    versions = []
    for version, share in (("first", 2), ("kept", 2), ("refreshed", 1)):
        versions.append(f"""select '{version}' as version, * from (
 with q as (select * from t where transaction_id % {share} = 0),
 c as (select count(*) filter (is_fraud <> 1 and prob < 0.5) as tn,
  count(*) filter (is_fraud <> 1 and prob >= 0.5) as fp,
  count(*) filter (is_fraud = 1 and prob < 0.5) as fn,
  count(*) filter (is_fraud = 1 and prob >= 0.5) as tp from q),
 a as (select sum(case when x.prob > y.prob then 1.0::double when x.prob = y.prob then 0.5 else 0 end)
  / count(*) as auc from q x, q y where x.is_fraud = 1 and y.is_fraud <> 1)
 select 'transaction' as model,
  round(coalesce(tp / nullif(tp + fp, 0), 0), 4) as precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0), 4) as recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) as f1_score,
  round(auc, 4) as auc_roc, tn as true_negative, fp as false_positive, fn as false_negative,
  tp as true_positive, tn + fp + fn + tp as test_set_size,
  round((tp + fn) * 100 / (tn + fp + fn + tp), 3) as fraud_rate_pct, 0.5::double as threshold
 from c, a)""")
    out["metrics_refresh"] = SCORED + f""",
t as (select transaction_id, {PROBABILITY} as prob, is_fraud from j, sc where is_test)
""" + " union all ".join(versions)
    out["history_from_nothing"] = f"""
select customer_id::varchar as customer_id, count(*) as n_rows from ({HOT}) group by all"""
    out["batch_default_time"] = violations() + """
select transaction_id, transaction_id % 3 = 0 as is_now from v where vs = ''"""
    out["generated_ids_of_requests"] = """
select event_type as merchant_category, count(*) as n_rows, count(*) as n_ids, count(*) as n_again
from events group by all"""
    out["append_scored_twice"] = SCORED + f"""
select transaction_id, customer_id,
 case when transaction_id % 2 = 0 then timestamp else timestamp + interval 3 days end as timestamp,
 round(prob * 100, 2) as fraud_probability, {LEVEL} as alert_level from p"""
    out["customer_timeline_stored"] = SCORED + f"""
select transaction_id, timestamp, risk_score, round(prob * 100, 2) as fraud_probability,
 {LEVEL} as alert_level from p where customer_id = {TIMELINE_CUSTOMER}
order by timestamp, transaction_id limit 100"""
    out["conflicting_ids"] = f"""
select transaction_id, 2::bigint as n_contents from ({EPISODES}) where transaction_id % 5 = 0"""
    out["stream_score_delayed"] = SCORED_SIM + f"""
select transaction_id, risk_score, round(prob * 100, 2) as fraud_probability, similarity_pct,
 {LEVEL} as alert_level, false as is_late from sim"""
    out["fraud_rings"] = rings(EPISODES, 2)
    out["fraud_rings_min_k"] = rings(HOT, 70)
    out["fraud_rings_orders"] = rings(ORDERS, 2)
    members = f"""
with c as (select device_id, customer_id, count(*) as n_txn from ({HOT})
 where device_id is not null group by all),
m as (select 'shared_device' as ring_type, device_id as identifier,
 row_number() over (partition by device_id order by customer_id) - 1 as position, customer_id, n_txn,
 count(*) over (partition by device_id) as n_customers,
 sum(n_txn) over (partition by device_id)::bigint as transaction_count from c)
"""
    out["fraud_rings_in_parts"] = members + """
select ring_type, identifier, n_customers, transaction_count, (position // 20)::int as page,
 string_agg(customer_id::varchar, ',' order by customer_id) as customer_ids
from m where n_customers >= 2 group by all"""
    out["ring_members"] = members + "select * from m where n_customers >= 2"
    out["customers_list"] = """
select customer_id, n_customers from (select customer_id, count(*) over () as n_customers
 from (select distinct o_custkey as customer_id from orders join customer on c_custkey = o_custkey))
order by customer_id limit 50"""
    out["customer_timeline"] = SCORED + f"""
select transaction_id, timestamp, risk_score, round(prob * 100, 2) as fraud_probability,
 {LEVEL} as alert_level from p where customer_id = {TIMELINE_CUSTOMER}
order by timestamp, transaction_id limit 100"""
    late = f"timestamp >= timestamp '{BATCH_CUT}'"
    out["batch_score"] = SCORED + f"""
select transaction_id, customer_id, amount, risk_score,
 round(prob * 100, 2) as fraud_probability, {LEVEL} as alert_level from p where {late}"""
    out["batch_score_summary"] = summary(SCORED, f"p where {late}")
    out["scored_log"] = SCORED_SIM + f"""
select transaction_id, customer_id, timestamp, amount, merchant_category, device_id, location,
 failed_logins_24h, risk_score, round(prob * 100, 2) as fraud_probability, similarity_pct,
 round(100 - similarity_pct, 2) as deviation_pct, {LEVEL} as alert_level from sim"""
    out["report_rows"] = report()
    out["json_requests"] = f"""
select customer_id, transaction_id::varchar as transaction_id, amount, merchant_category,
 device_id, location, failed_logins_24h::varchar as failed_logins_24h from ({BATCH})"""
    out["scored_json"] = REASONS + f"""
select p.transaction_id, {LEVEL} as alert_level,
 cast(count(top.transaction_id) as int) as n_reasons
from p left join top on top.transaction_id = p.transaction_id
group by p.transaction_id, prob"""
    out["stream_score"] = SCORED_SIM + f"""
select transaction_id, risk_score, round(prob * 100, 2) as fraud_probability, similarity_pct,
 {LEVEL} as alert_level from sim"""
    shown = ("transaction_id, customer_id, amount, risk_score, round(prob * 100, 2) as fraud_probability,"
             f" similarity_pct, {LEVEL} as alert_level")
    half = f"timestamp >= timestamp '{HALF}'"
    out["batch_score_from_snapshot"] = SCORED_SIM + f"""
select {shown} from sim where {late} or (customer_id % 5 = 0 and day(timestamp) between 9 and 10)"""
    out["batch_score_carried"] = SCORED_SIM + f"select {shown} from sim where {half}"
    means = ", ".join(f"round(avg({f}::double) + 1e-9, 6) as mean_{f}" for f in F9)
    used = " union all ".join(f"select customer_id, '{k}' as kind, {c} as value from f"
                              for k, c in SN.KINDS.items())
    out["customer_snapshots"] = SKEWED_F + f""",
ends as (select customer_id, max(epoch_us(timestamp)) as last from f group by customer_id),
uses as (select customer_id, kind, value, count(*) as n from ({used}) group by all),
v as (select customer_id, count(*) as n_values, sum(n)::bigint as n_uses from uses group by customer_id)
select f.customer_id, count(*) as n, round(avg(amount) + 1e-9, 6) as mean, round(stddev_pop(amount) + 1e-9, 6) as std, last,
 cast(count(*) filter (epoch_us(timestamp) >= last - 3600000000) as int) as n_recent,
 cast(least(count(*), 10) as int) as n_steps, count(*) filter (hour(timestamp) = 12) as n_at_noon,
 any_value(n_values) as n_values, any_value(n_uses) as n_uses, {means}
from f join ends using (customer_id) join v using (customer_id) group by f.customer_id, last"""
    out["stream_score_continued"] = out["stream_score"] + f" where {half}"
    out["stream_behaviour_continued"] = SKEWED_F + risk() + similarity_cte("r") + f"""
select customer_id, transaction_id, {FEATURE_OUT}, risk_score, similarity_pct from sim where {half}"""
    valid = f"""
select * replace (coalesce(nullif(device_id, ''), 'DEV_' || customer_id || '_A') as device_id,
  coalesce(nullif(location, ''), '{C.DEFAULT_LOCATION}') as location,
  cast(coalesce(failed_logins_24h, 0) as int) as failed_logins_24h), 0 as is_fraud
from ({BATCH}) where customer_id is not null and amount > 0 and merchant_category is not null
 and coalesce(failed_logins_24h, 0) >= 0"""
    out["stream_checked_scored"] = features(valid, EPISODE_HOME) + risk() + similarity_cte("r") + """
select customer_id, transaction_id, device_id, location, failed_logins_24h, risk_score, similarity_pct from sim"""
    out["stream_rejected"] = violations() + """
select transaction_id, vs as violations, merchant_category as given_category from v where vs <> ''"""
    out["stream_alert_counts"] = SCORED + f"""
select date_trunc('day', timestamp) as day, {LEVEL} as alert_level, count(*) as n
from p group by all"""
    out["stream_rings"] = rings(EPISODES, 2)
    return out
