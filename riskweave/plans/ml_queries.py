"""Queries of models: fits from sums have SQL, the others are held to their invariants by tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.functions.scalars import micros
from riskweave.operators import evaluation as E
from riskweave.operators import features as B
from riskweave.operators import ml
from riskweave.operators.fits import IsotonicBlocks, NewtonPlatt, logistic, newton_logistic
from riskweave.plans.fixtures import txn
from riskweave.plans.queries import rounded, with_scores
from riskweave.sources.files import checkpointed

INPUTS = ["amount_z_score", "customer_seconds_since_previous", "device_novelty", "country_novelty", "is_cash_withdrawal", "transaction_amount", "rule_score"]
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def rows(spark, sf_dir):
    df = B.rule_features(txn(spark, sf_dir)).withColumn("us", micros("event_time"))
    # the device stands for what is known of the error type, so that there is something to learn
    return df.withColumn("label", F.col("fraud_label").cast("double"))


def _fitted(spark, sf_dir):
    df = rows(spark, sf_dir)
    parts = E.chronological_split(df, "us", "event_id").persist()
    model = ml.pipeline("logistic_regression", INPUTS).fit(ml.with_class_weights(parts.where("split = 'train'")))
    return model, parts


@query
def k01_k02_k03_baselines(spark, sf_dir):
    seen = ["event_id", "us", "label", *INPUTS]  # the amount is an input too
    _, metrics, _ = ml.train_baselines(checkpointed(rows(spark, sf_dir).select(*seen)), INPUTS)
    return rounded(metrics.select("model", "split", "precision", "recall", "average_precision", "expected_cost"))


@query
def k08_distributed_scores(spark, sf_dir):
    model, parts = _fitted(spark, sf_dir)
    return ml.scored_by(model, parts).select("event_id", "split", "score")


@query
def k05_isolation_scores(spark, sf_dir):
    df = checkpointed(rows(spark, sf_dir).select("event_id", "event_time", *INPUTS))
    trees = ml.isolation_trees(df.where(F.col("event_time") < F.lit("2024-01-16").cast("timestamp_ntz")), INPUTS, "event_id")
    out = checkpointed(ml.isolation_scores(df, trees, INPUTS).select("event_id", "anomaly"))
    return E.min_max(out, out, "anomaly", "scaled").select("event_id", "anomaly", "scaled")


@query
def k09_platt_calibration(spark, sf_dir):
    model, parts = _fitted(spark, sf_dir)
    scores = ml.scored_by(model, parts)
    return ml.Platt(scores.where("split = 'validation'")).apply(scores.where("split = 'test'")).select("event_id", "score", "calibrated")


@query
def k10_isotonic_calibration(spark, sf_dir):
    model, parts = _fitted(spark, sf_dir)
    scores = ml.scored_by(model, parts)
    return ml.Isotonic(scores.where("split = 'validation'")).apply(scores.where("split = 'test'")).select("event_id", "score", "calibrated")


@query
def k12_removal_contributions(spark, sf_dir):
    model, parts = _fitted(spark, sf_dir)
    return ml.removal_contributions(model, parts.where("split = 'test'"), parts.where("split = 'train'"), "event_id", INPUTS)


@query
def k14_counterfactuals(spark, sf_dir):
    return ml.counterfactuals(k12_removal_contributions(spark, sf_dir))


@query
def k13_permutation_importance(spark, sf_dir):
    model, parts = _fitted(spark, sf_dir)
    return ml.permutation_importance(model, parts.where("split = 'validation'"), "event_id", INPUTS)



@query
def k05_anomaly_flags(spark, sf_dir):
    """Scores over the cut that the training rows' share of frauds sets. Inputs and scores are made once."""
    df = checkpointed(rows(spark, sf_dir).select("event_id", "event_time", "label", *INPUTS))
    train = df.where(_EARLY)
    trees = ml.isolation_trees(train, INPUTS, "event_id")
    scored = checkpointed(ml.isolation_scores(df, trees, INPUTS).select("event_id", "event_time", "label", "anomaly"))
    return ml.with_anomaly_flags(scored, scored.where(_EARLY)).select("event_id", "label", "anomaly", "is_anomaly")


# --- fits from sums: SQL takes the same steps ------------------------------------------------------------------------

_EARLY = "event_time < timestamp '2024-01-16'"
_SCORED = with_scores("", *["dat AS (SELECT event_id, event_time, CAST(label AS DOUBLE) AS y, CAST(score AS DOUBLE) AS s, CAST(least(greatest(amount_z_score, -3), 3) AS DOUBLE) AS z, CAST(device_novelty AS DOUBLE) AS v FROM scores)"])
STEPS = 8


def _inputs(spark, sf_dir):
    df = rows(spark, sf_dir).withColumn("score", F.round("rule_score", 6))
    return df.withColumns({"z": F.least(F.greatest("amount_z_score", F.lit(-3.0)), F.lit(3.0)), "v": F.col("device_novelty")})


def _newton_sql(names: list[str]) -> str:
    """A recursive table `fit` (step, b0, b1, ...) of Newton steps, each solved by Cramer's rule."""
    d = len(names) + 1
    x = ["1.0", *names]
    p = "(1 / (1 + exp(-(" + " + ".join(f"b{k} * {c}" for k, c in enumerate(x)) + "))))"
    sums = [f"sum({a} * {b} * {p} * (1 - {p})) AS h{i}{j}" for i, a in enumerate(x) for j, b in enumerate(x) if i <= j] + [f"sum({a} * (y - {p})) AS g{i}" for i, a in enumerate(x)]
    h = [[f"h{min(i, j)}{max(i, j)}" for j in range(d)] for i in range(d)]

    def determinant(m):
        return f"({m[0][0]} * {m[1][1]} - {m[0][1]} * {m[1][0]})" if len(m) == 2 else "(" + " + ".join(f"{'-' if k % 2 else ''}{m[0][k]} * {determinant([r[:k] + r[k + 1 :] for r in m[1:]])}" for k in range(len(m))) + ")"

    solved = [f"b{k} + {determinant([[f'g{i}' if j == k else h[i][j] for j in range(d)] for i in range(d)])} / {determinant(h)} AS b{k}" for k in range(d)]
    b = ", ".join(f"b{k}" for k in range(d))
    early = "SELECT * FROM dat WHERE event_time < TIMESTAMP '2024-01-16'"
    return f"fit AS (SELECT 0 AS step, {', '.join(f'CAST(0 AS DOUBLE) AS b{k}' for k in range(d))} UNION ALL SELECT step + 1, {', '.join(solved)} FROM (SELECT step, {b}, {', '.join(sums)} FROM fit, ({early}) e WHERE step < {STEPS} GROUP BY step, {b}) q)"


def _fit_sql(names: list[str], out: str) -> str:
    beta = "b0 + " + " + ".join(f"b{k + 1} * {c}" for k, c in enumerate(names))
    body = f" SELECT event_id, round(1 / (1 + exp(-({beta}))), 6) AS {out} FROM dat, (SELECT * FROM fit WHERE step = {STEPS}) f WHERE event_time >= TIMESTAMP '2024-01-16'"
    return "WITH RECURSIVE " + _SCORED.strip().removeprefix("WITH ") + ", " + _newton_sql(names) + body


ORACLES["k02_newton_logistic"] = _fit_sql(["z", "v"], "probability")
ORACLES["k09_newton_platt"] = _fit_sql(["s"], "calibrated")
ORACLES["k10_isotonic_blocks"] = (
    _SCORED
    + """, pts AS (SELECT s, sum(y) AS t, count(*) AS n FROM dat WHERE event_time < TIMESTAMP '2024-01-16' GROUP BY s),
means AS (SELECT a.s AS lo, b.s AS hi, (SELECT sum(t) / sum(n) FROM pts c WHERE c.s BETWEEN a.s AND b.s) AS m FROM pts a JOIN pts b ON b.s >= a.s),
curve AS (SELECT p.s, max(least_m) AS value FROM pts p JOIN (SELECT q.s, m.lo, min(m.m) AS least_m FROM pts q JOIN means m ON m.lo <= q.s AND m.hi >= q.s GROUP BY q.s, m.lo) x ON x.s = p.s GROUP BY p.s)
SELECT event_id, round(least(1.0, greatest(0.0, CASE WHEN below.s IS NULL THEN above.value WHEN above.s IS NULL THEN below.value WHEN below.s = above.s THEN below.value
  ELSE below.value + (above.value - below.value) * (d.s - below.s) / (above.s - below.s) END)), 6) AS calibrated
FROM dat d LEFT JOIN curve below ON below.s = (SELECT max(s) FROM curve c WHERE c.s <= d.s) LEFT JOIN curve above ON above.s = (SELECT min(s) FROM curve c WHERE c.s >= d.s)
WHERE event_time >= TIMESTAMP '2024-01-16'"""
)


#: What the explained model sees; the amount in thousands keeps its step sizes alike.
SEEN = ["z", "v", "a"]
_PARTS = "early AS (SELECT * FROM dat WHERE event_time < TIMESTAMP '2024-01-16'), late AS (SELECT * FROM dat WHERE event_time >= TIMESTAMP '2024-01-16')"
_CHANCE = "1 / (1 + exp(-(b0 + b1 * {z} + b2 * {v} + b3 * {a})))"


def _explained_sql(more: str, body: str) -> str:
    seen = _SCORED.replace("AS v FROM scores", "AS v, CAST(transaction_amount AS DOUBLE) / 1000 AS a FROM scores")
    beta = f"beta AS (SELECT * FROM fit WHERE step = {STEPS})"
    return f"WITH RECURSIVE {seen.strip().removeprefix('WITH ')}, {_newton_sql(SEEN)}, {_PARTS}, {beta}, {more} {body}"


def _removed_sql() -> str:
    chances = [(c, _CHANCE.format(**{x: f"m.m{x}" if x == c else f"d.{x}" for x in SEEN})) for c in SEEN]
    whole = _CHANCE.format(**{x: f"d.{x}" for x in SEEN})
    one = " UNION ALL ".join(f"SELECT event_id, '{c}' AS feature, d.{c} AS value, {chance} AS resulting_score, {whole} AS score FROM late d, beta, means m" for c, chance in chances)
    return f"means AS (SELECT {', '.join(f'avg({c}) AS m{c}' for c in SEEN)} FROM early), removed AS ({one})"


ORACLES["k12_newton_contributions"] = _explained_sql(_removed_sql(), "SELECT event_id, feature, round(value, 6) AS value, round(score - resulting_score, 6) + 0.0 AS contribution, round(resulting_score, 6) AS resulting_score, round(score, 6) AS score FROM removed")
#: The cut is the share of frauds of the early rows, which a model without weights is around.
ORACLES["k14_newton_counterfactuals"] = _explained_sql(_removed_sql(), "SELECT event_id, feature, round(score, 6) AS score, round(resulting_score, 6) AS resulting_score FROM removed, (SELECT avg(y) AS cut FROM early) WHERE score >= cut AND resulting_score < cut")
ORACLES["k13_newton_importance"] = _explained_sql(
    f"""placed AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '42', 'to', event_id)), event_id) AS place FROM late),
dealt AS (SELECT r AS repeat, l.*, row_number() OVER (PARTITION BY r ORDER BY md5(concat_ws('|', '42', CAST(r AS VARCHAR), event_id)), event_id) AS place FROM late l, range(5) g(r)),
shuffled AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, repeat, d.y, {_CHANCE.format(**{x: f'o.{x}' if x == c else f'd.{x}' for x in SEEN})} AS p FROM placed d JOIN dealt o USING (place), beta" for c in SEEN)}
  UNION ALL SELECT '' AS feature, 0 AS repeat, d.y, {_CHANCE.format(**{x: f"d.{x}" for x in SEEN})} AS p FROM late d, beta),
points AS (SELECT feature, repeat, round(p, 9) AS s, sum(y) AS pos, count(*) AS n FROM shuffled GROUP BY ALL),
curve AS (SELECT feature, repeat, pos, sum(pos) OVER w AS cp, sum(n) OVER w AS cn, sum(pos) OVER (PARTITION BY feature, repeat) AS ap FROM points WINDOW w AS (PARTITION BY feature, repeat ORDER BY s DESC)),
areas AS (SELECT feature, repeat, sum(pos / ap * cp / cn) AS area FROM curve GROUP BY feature, repeat)""",
    "SELECT a.feature, round(avg(b.area - a.area), 6) + 0.0 AS importance, round(stddev_pop(b.area - a.area), 6) + 0.0 AS deviation FROM areas a, (SELECT area FROM areas WHERE feature = '') b WHERE a.feature <> '' GROUP BY a.feature",
)


def _explained(spark, sf_dir):
    """(model as a column, early rows, late rows)."""
    df = _inputs(spark, sf_dir).withColumn("a", F.col("transaction_amount").cast("double") / 1000)
    early = df.where(_EARLY)
    return logistic(newton_logistic(early, SEEN, steps=STEPS), SEEN), early, df.where(f"not {_EARLY}")


@query
def k12_newton_contributions(spark, sf_dir):
    model, early, late = _explained(spark, sf_dir)
    return rounded(ml.removal_contributions(model, late, early, "event_id", SEEN))


@query
def k14_newton_counterfactuals(spark, sf_dir):
    model, early, late = _explained(spark, sf_dir)
    cut = early.agg(F.avg("label")).first()[0]
    found = ml.counterfactuals(ml.removal_contributions(model, late, early, "event_id", SEEN), cut)
    return rounded(found.select("event_id", "feature", "score", "resulting_score"))


@query
def k13_newton_importance(spark, sf_dir):
    """Chances go by nine places, so that equal ones stay equal in both engines."""
    model, _, late = _explained(spark, sf_dir)
    return rounded(ml.permutation_importance(F.round(model, 9), late, "event_id", SEEN))


@query
def k02_newton_logistic(spark, sf_dir):
    df = _inputs(spark, sf_dir)
    beta = newton_logistic(df.where(_EARLY), ["z", "v"], steps=STEPS)
    return rounded(df.where(f"not {_EARLY}").select("event_id", logistic(beta, ["z", "v"]).alias("probability")))


@query
def k09_newton_platt(spark, sf_dir):
    df = _inputs(spark, sf_dir)
    return rounded(NewtonPlatt(df.where(_EARLY), steps=STEPS).apply(df.where(f"not {_EARLY}")).select("event_id", "calibrated"))


@query
def k10_isotonic_blocks(spark, sf_dir):
    df = _inputs(spark, sf_dir)
    return rounded(IsotonicBlocks(df.where(_EARLY)).apply(df.where(f"not {_EARLY}")).select("event_id", "calibrated"))
