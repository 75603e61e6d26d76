"""Prequential online learning with drift detection, per key, on batches and on streams.

A learner sees its key's steps in order: it chooses an arm, is rewarded, learns, and starts afresh on an alarm of
its drift detector. Its state is a few numbers; keys are independent, so they spread over the cluster, while one
key's steps are sequential by nature and pass through a single task in constant memory.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .drift import Adwin

if TYPE_CHECKING:
    import pandas as pd

ARMS = 11
#: Steps of one counting range.
RANGE = 65536
# The mixing weights that users prefer before and after the change, and the share of flipped labels.
IDEAL_BEFORE, IDEAL_AFTER, FLIP = 0.25, 0.85, 0.05


def draw(*what: object) -> float:
    """A number in [0, 1) that depends on its arguments only."""
    return int(hashlib.md5(":".join(map(str, what)).encode()).hexdigest()[:8], 16) / (1 << 32)


def drawn(*what: Column | str) -> Column:
    """The same as draw(), as an expression."""
    joined = F.concat_ws(":", *[w if isinstance(w, Column) else F.lit(w) for w in what])
    return F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("double") / (1 << 32)


def helpful_probability(weight: Column, ideal: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - 2 * F.abs(weight - ideal))


def feedback_stream(questions: DataFrame, steps: int = 1200, drift_at: int = 600, seed: int = 7) -> DataFrame:
    """(step, qid, regime, ideal): a question drawn for every step, and what its users prefer.

    questions (qid, place) numbers them from 0; an empty table gives no steps.
    """
    n = F.broadcast(questions.agg(F.count("*").alias("n")))
    s = questions.sparkSession.range(steps).withColumnRenamed("id", "step").crossJoin(n).where("n > 0")
    s = s.withColumn("place", F.floor(drawn(f"{seed}", F.col("step").cast("string")) * F.col("n")).cast("long"))
    before = F.col("step") < drift_at
    return s.join(questions, "place").select("step", "qid", F.when(before, "pre").otherwise("post").alias("regime"), F.when(before, IDEAL_BEFORE).otherwise(IDEAL_AFTER).alias("ideal"))


@dataclass
class Learner:
    """Arms with a logistic model of one weight each and an intercept, chosen greedily but for a share of draws."""

    epsilon: float = 0.1
    rate: float = 0.01
    delta: float = 0.002

    def __post_init__(self) -> None:
        self.weights, self.bias = [0.0] * ARMS, 0.0
        self.detector, self.step, self.alarms, self.sum, self.static_sum = Adwin(self.delta), 0, 0, 0.0, 0.0

    def dump(self) -> str:
        return json.dumps([self.weights, self.bias, self.detector.state(), self.step, self.alarms, self.sum, self.static_sum])

    @classmethod
    def load(cls, text: str, **settings: float) -> Learner:
        out = cls(**settings)
        out.weights, out.bias, state, out.step, out.alarms, out.sum, out.static_sum = json.loads(text)
        out.detector = Adwin(out.delta, state=state)
        return out

    def choose(self, key: object, step: int) -> int:
        if draw("explore", key, step) < self.epsilon:
            return int(draw("arm", key, step) * ARMS)
        return max(range(ARMS), key=lambda a: (self.weights[a], -a))

    def learn(self, arm: int, reward: float) -> bool:
        """One step of gradient descent; true if the detector reports a change, which resets the model."""
        p = 1 / (1 + math.exp(-(self.weights[arm] + self.bias)))
        self.weights[arm] -= self.rate * (p - reward)
        self.bias -= self.rate * (p - reward)
        self.step += 1
        self.sum += reward
        if changed := self.detector.update(reward):
            self.alarms += 1
            self.weights, self.bias = [0.0] * ARMS, 0.0
        return changed


def reward(key: object, step: int, weight: float, ideal: float, who: str = "adaptive") -> float:
    helped = float(draw("helped", who, key, step) < max(0.0, 1 - 2 * abs(weight - ideal)))
    return 1 - helped if draw("flip", who, key, step) < FLIP else helped


LOG = "step long, qid {qid}, regime string, ideal double, chosen double, r_adaptive double, r_static double, adaptive_mean double, static_mean double, alarm boolean"


def simulate(stream: DataFrame, key: str, static: float = 0.3944, **settings: float) -> DataFrame:
    """key and the log of every step of (key, step, qid, regime, ideal), each key by itself and in order.

    Rows are sorted within tasks and pass through with one learner at a time, so no key is ever held in memory.
    """
    columns = [key, "step", "qid", "regime", "ideal"]
    kinds = dict(stream.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        now, learner = object(), Learner(**settings)
        for b in batches:
            out = []
            for k, step, qid, regime, ideal in zip(*(b[c] for c in columns)):
                if k != now:
                    now, learner = k, Learner(**settings)
                arm = learner.choose(k, step)
                weight = arm / (ARMS - 1)
                r, fixed = reward(k, step, weight, ideal), reward(k, step, static, ideal, "static")
                alarm = learner.learn(arm, r)
                learner.static_sum += fixed
                out.append((k, step, qid, regime, ideal, weight, r, fixed, learner.sum / learner.step, learner.static_sum / learner.step, alarm))
            yield pd.DataFrame(out, columns=[key, *[c.split()[0] for c in LOG.split(", ")]])

    rows = stream.select(*columns).repartition(F.col(key)).sortWithinPartitions(key, "step")
    return rows.mapInPandas(run, f"`{key}` {kinds[key]}, {LOG.format(qid=kinds['qid'])}")


def learn_events(events: DataFrame, key: str, step: str, arm: Column, helped: Column, **settings: float) -> DataFrame:
    """(key, steps, helpful, alarms, best_arm): what a learner per key makes of logged arms and rewards."""
    kinds = dict(events.dtypes)
    rows = events.select(F.col(key).alias("k"), F.col(step).alias("s"), arm.alias("a"), helped.cast("double").alias("r")).where("a IS NOT NULL AND r IS NOT NULL")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        now, learner = None, None
        close = lambda k, x: (k, x.step, round(x.sum / x.step, 6), x.alarms, max(range(ARMS), key=lambda a: (x.weights[a], -a)))
        columns = [key, "steps", "helpful", "alarms", "best_arm"]
        for b in batches:
            out = []
            for k, a, r in zip(b["k"], b["a"], b["r"]):
                if learner is None or k != now:
                    if learner is not None:
                        out.append(close(now, learner))
                    now, learner = k, Learner(**settings)
                learner.learn(int(a), float(r))
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame([close(now, learner)] if learner is not None else [], columns=columns)

    return rows.repartition(F.col("k")).sortWithinPartitions("k", "s").mapInPandas(run, f"`{key}` {kinds[key]}, steps long, helpful double, alarms int, best_arm int")


def learn_stream(events: DataFrame, key: str, step: str, arm: Column, helped: Column, **settings: float) -> DataFrame:
    """The same on a stream: after every batch, each key that had events reports its learner so far.

    State survives restarts with the query's checkpoint. A key's events are ordered within a batch; batches come
    in order of arrival.
    """
    kind = dict(events.dtypes)[key]
    rows = events.select(F.col(key).alias("k"), F.col(step).alias("s"), arm.alias("a"), helped.cast("double").alias("r")).where("a IS NOT NULL AND r IS NOT NULL")

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        import pandas as pd

        learner = Learner.load(state.get[0], **settings) if state.exists else Learner(**settings)
        for b in batches:
            b = b.sort_values("s")
            for a, r in zip(b["a"], b["r"]):
                learner.learn(int(a), float(r))
        state.update((learner.dump(),))
        yield pd.DataFrame([(k[0], learner.step, round(learner.sum / learner.step, 6), learner.alarms)], columns=[key, "steps", "helpful", "alarms"])

    return rows.groupBy("k").applyInPandasWithState(run, f"`{key}` {kind}, steps long, helpful double, alarms int", "learner string", "update", "NoTimeout")


def numbered(events: DataFrame, order: str) -> DataFrame:
    """Adds step, counting from 1 in the order of a unique whole number: within ranges, then over them."""
    r = events.withColumn("r", F.floor(F.col(order) / RANGE))
    before = r.groupBy("r").agg(F.count("*").alias("c")).select("r", F.coalesce(F.sum("c").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return r.withColumn("i", F.row_number().over(Window.partitionBy("r").orderBy(order))).join(before, "r").withColumn("step", F.col("before") + F.col("i")).drop("r", "i", "before")


def running_mean(steps: DataFrame, value: str) -> DataFrame:
    """step and the mean up to it; sums are taken within ranges, then over them."""
    r = steps.select("step", F.col(value).alias("v"), F.floor(F.col("step") / RANGE).alias("r"))
    before = r.groupBy("r").agg(F.sum("v").alias("c")).select("r", F.coalesce(F.sum("c").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"))
    inside = r.withColumn("s", F.sum("v").over(Window.partitionBy("r").orderBy("step")))
    return inside.join(before, "r").select("step", F.round((F.col("before") + F.col("s")) / F.col("step"), 6).alias("mean"))


def rolling_mean(steps: DataFrame, value: str, width: int = 50, span: int = 8192) -> DataFrame:
    """step and the mean of the last `width` steps; ranges take over what they need of the one before."""
    r = F.floor(F.col("step") / span)
    late = F.pmod(F.col("step"), F.lit(span)) >= span - width
    rows = steps.select("step", F.col(value).alias("v"), F.explode(F.when(late, F.array(r, r + 1)).otherwise(F.array(r))).alias("r"))
    mean = F.avg("v").over(Window.partitionBy("r").orderBy("step").rowsBetween(1 - width, 0))
    return rows.withColumn("mean", F.round(mean, 6)).where(F.col("r") == r).select("step", "mean")
