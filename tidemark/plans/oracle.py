"""DuckDB SQL building blocks: named CTEs that oracles pull in with their dependencies."""

from __future__ import annotations

import re

from tidemark.config import AUC_WEIGHT, HORIZONS, LABELS, LL_SCALE, LL_WEIGHT

DAY_OF = "datediff('day', DATE '1970-01-01', CAST({} AS DATE))"


def _labels(expr: str, sep: str = ", ") -> str:
    return sep.join(expr.format(h=h, y=y, n=HORIZONS[h]) for h, y in LABELS.items())


def score_expr(loss: str, auc: str) -> str:
    """Weighted-score share of one horizon row."""
    cases = " ".join(
        f"WHEN '{h}' THEN {AUC_WEIGHT[h]}e0*{auc} + {LL_WEIGHT[h]}e0*(1-{loss}/{LL_SCALE}e0)"
        for h in LABELS)
    return f"CASE horizon {cases} END"


CTES: dict[str, str] = {
    "ord": f"""SELECT o_orderkey AS row_id, o_custkey, o_orderstatus, o_orderpriority,
        {DAY_OF.format('o_orderdate')} AS day, CAST(o_orderdate AS DATE) AS training_day
        FROM orders""",
    "bounds": "SELECT min(day) AS lo, max(day) AS hi FROM ord",
    "cal": """SELECT o_custkey, day, lead(day) OVER (PARTITION BY o_custkey ORDER BY day) AS next_day
        FROM (SELECT DISTINCT o_custkey, day FROM ord)""",
    "lines": """SELECT l_orderkey,
        'TRA_' || CAST(arg_min(l_suppkey, row(l_linenumber, l_suppkey)) AS VARCHAR) AS trainer,
        list_sort(list_distinct(list(p_name))) AS topics
        FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey""",
    "log": f"""SELECT o.row_id, 'F' || o.o_custkey AS farmer_name, o.day, o.training_day,
        coalesce(trainer, 'UNKNOWN') AS trainer,
        coalesce(topics, CAST([] AS VARCHAR[])) AS topics,
        c_mktsegment AS gender, o_orderstatus AS registration,
        CASE WHEN c_acctbal < 0 THEN 'A0' WHEN c_acctbal < 2500 THEN 'A1'
             WHEN c_acctbal < 5000 THEN 'A2' WHEN c_acctbal < 7500 THEN 'A3' ELSE 'A4' END AS age,
        r_name AS county, n_name AS subcounty, n_name || '_' || c_mktsegment AS ward,
        c_mktsegment || '_' || o_orderpriority AS group_name,
        CAST(c_acctbal >= 5000 AS INT) AS belong_to_cooperative,
        CAST(len(coalesce(topics, [])) > 0 AS INT) AS has_topic_trained_on,
        {_labels("CAST(coalesce(next_day - o.day <= {n}, FALSE) AS INT) AS {y}")},
        CASE WHEN o.day < lo + CAST(floor(0.4e0 * (hi - lo)) AS INT) THEN 'prior'
             WHEN o.day <= hi - 120 THEN 'train' ELSE 'test' END AS period
        FROM ord o CROSS JOIN bounds
        LEFT JOIN cal ON cal.o_custkey = o.o_custkey AND cal.day = o.day
        LEFT JOIN lines ON l_orderkey = o.row_id
        LEFT JOIN customer ON c_custkey = o.o_custkey
        LEFT JOIN nation ON n_nationkey = c_nationkey
        LEFT JOIN region ON r_regionkey = n_regionkey""",
    "prior": "SELECT * FROM log WHERE period = 'prior'",
    "train": "SELECT * FROM log WHERE period = 'train'",
    "test": "SELECT * FROM log WHERE period = 'test'",
    "span": "SELECT CAST(min(day) AS DOUBLE) AS lo, CAST(max(day) AS DOUBLE) AS hi FROM train",
    "folds": """SELECT CAST(i + 1 AS INT) AS fold,
        lo + (hi - lo) * (0.3e0 + (i + 1) * (1 - 0.3e0) / (5 + 1)) AS cutoff,
        lo + (hi - lo) * (0.3e0 + (i + 2) * (1 - 0.3e0) / (5 + 1)) AS until
        FROM range(5) t(i) CROSS JOIN span""",
    "fold_train": "SELECT t.*, fold FROM train t JOIN folds ON day < cutoff",
    "fold_val": "SELECT t.*, fold FROM train t JOIN folds ON day >= cutoff AND day < until",
    "fold_rate": f"SELECT fold, {_labels('avg({y}) AS g{h}')} FROM fold_train GROUP BY fold",
    "oof_key": """SELECT 'ward_rate' AS model, 'ward' AS key_name UNION ALL
        SELECT 'group_rate', 'group_name' UNION ALL SELECT 'trainer_rate', 'trainer'""",
    "fold_key": f"""SELECT fold, key_name, CASE key_name WHEN 'ward' THEN ward
            WHEN 'group_name' THEN group_name ELSE trainer END AS key_value, count(*) AS n,
            {_labels('CAST(sum({y}) AS BIGINT) AS s{h}')}
        FROM fold_train CROSS JOIN oof_key GROUP BY 1, 2, 3""",
    "oof_raw": f"""SELECT model, row_id, v.fold, {_labels('''least(greatest(round(coalesce(
            (s{h} + 10e0 * g{h}) / (n + 10e0), g{h}), 6), 0.001e0), 0.999e0) AS q{h}''')},
            {_labels('{y}')}
        FROM fold_val v CROSS JOIN oof_key k JOIN fold_rate r ON r.fold = v.fold
        LEFT JOIN fold_key c ON c.fold = v.fold AND c.key_name = k.key_name AND c.key_value =
            CASE k.key_name WHEN 'ward' THEN ward WHEN 'group_name' THEN group_name
            ELSE trainer END""",
    "oof": f"""SELECT model, row_id, fold, least(q07, least(q90, q120)) AS p07,
        least(q90, q120) AS p90, q120 AS p120, {_labels('{y}')} FROM oof_raw""",
    "long": " UNION ALL ".join(
        f"SELECT model, row_id, fold, '{h}' AS horizon, p{h} AS p, {y} AS y FROM oof"
        for h, y in LABELS.items()),
    "hist": """SELECT model, fold, horizon, p, CAST(count(*) AS DOUBLE) AS n,
        CAST(sum(y) AS DOUBLE) AS pos FROM long GROUP BY 1, 2, 3, 4""",
    "hist_all": """SELECT model, horizon, p, sum(n) AS n, sum(pos) AS pos FROM hist
        GROUP BY 1, 2, 3""",
}


def metric_cte(source: str, keys: str) -> str:
    """Log-loss and AUC per key from a histogram CTE."""
    return f"""SELECT {keys}, CAST(sum(n) AS BIGINT) AS n, CAST(sum(pos) AS BIGINT) AS pos,
        sum(loss) / sum(n) AS log_loss,
        CASE WHEN sum(pos) * sum(n - pos) > 0 THEN sum(pos * (below + 0.5e0 * (n - pos)))
             / (sum(pos) * sum(n - pos)) ELSE 0.5e0 END AS roc_auc
        FROM (SELECT *, -(pos * ln(p) + (n - pos) * ln(1 - p)) AS loss,
            coalesce(sum(n - pos) OVER (PARTITION BY {keys} ORDER BY p
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM {source})
        GROUP BY {keys}"""


CTES["fold_metric"] = metric_cte("hist", "model, fold, horizon")
CTES["all_metric"] = metric_cte("hist_all", "model, horizon")
CTES["fold_score"] = f"""SELECT model, fold, sum({score_expr('log_loss', 'roc_auc')}) AS score
    FROM fold_metric GROUP BY model, fold"""
CTES["fold_stat"] = """SELECT model, avg(score) AS mean_score, stddev_pop(score) AS fold_std,
    min(score) AS worst_fold, arg_max(score, fold) AS last_fold FROM fold_score GROUP BY model"""
CTES["summary"] = f"""SELECT model, sum({score_expr('log_loss', 'roc_auc')}) AS score,
    {_labels("max(CASE WHEN horizon = '{h}' THEN log_loss END) AS ll{h}")},
    {_labels("max(CASE WHEN horizon = '{h}' THEN roc_auc END) AS auc{h}")},
    any_value(mean_score) AS mean_score, any_value(fold_std) AS fold_std,
    any_value(worst_fold) AS worst_fold, any_value(last_fold) AS last_fold
    FROM all_metric JOIN fold_stat USING (model) GROUP BY model"""


def sql(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix a SELECT with every CTE it names, dependencies first."""
    pool = {**CTES, **(extra or {})}
    done: list[str] = []

    def visit(text: str) -> None:
        for name in pool:
            if name not in done and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                visit(pool[name])
                if name not in done:
                    done.append(name)

    visit(body)
    if not done:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({pool[n]})" for n in done) + "\n" + body


def labels(expr: str, sep: str = ", ") -> str:
    """``expr`` once per horizon, with {h} (07, 90, 120), {y} (label column) and {n} (days)."""
    return _labels(expr, sep)
