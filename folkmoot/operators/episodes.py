"""Episodes of (state, action, next state, reward) and their metrics (inventory J17 to J29)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folkmoot._store import few, kept
from folkmoot.operators.scans import row_number

BROADCAST_COUNTRIES = 10_000
COUNTRIES_IN_LIST, SHARES = 1000, 64  # of a longer table of countries, and of the trajectories that meet a list

# Codes of stages and actions, which actions a stage allows, and the order of a state's numbers.
STAGE_NAMES = ["DRAFT", "COMMITTEE_VOTE", "PLENARY_VOTE", "TERMINAL"]
ACTION_NAMES = ["COSPONSOR", "VOTE_YES", "VOTE_NO", "VOTE_ABSTAIN", "NO_ACTION"]
COSPONSOR, VOTE_YES, VOTE_NO, VOTE_ABSTAIN, NO_ACTION = range(5)
SCALARS = ["topic_id", "sponsor_count", "agent_is_sponsor", "committee_yes", "committee_no", "committee_abstain", "plenary_yes", "plenary_no", "plenary_abstain", "t"]
VALID = {0: [COSPONSOR, NO_ACTION], 1: [VOTE_YES, VOTE_NO, VOTE_ABSTAIN], 2: [VOTE_YES, VOTE_NO, VOTE_ABSTAIN], 3: [NO_ACTION]}
LISTS = {"yes": VOTE_YES, "no": VOTE_NO, "abstain": VOTE_ABSTAIN}


def country_action(sponsors: Column, yes: Column, no: Column, abstain: Column, country: Column, draft_stage: Column) -> Column:
    """The code of what a country does at a step; null where a vote does not list it."""
    has = lambda a: F.coalesce(F.array_contains(a, country), F.lit(False))
    return F.when(draft_stage, F.when(has(sponsors), COSPONSOR).otherwise(NO_ACTION)).when(has(yes), VOTE_YES).when(has(no), VOTE_NO).when(has(abstain), VOTE_ABSTAIN)


def reward(is_sponsor: Column, outcome: Column) -> Column:
    """J19."""
    return F.when(~is_sponsor, 0.0).when(F.lower(outcome) == "adopted", 1.0).otherwise(-1.0)


def state(stage: int, **known: Column) -> Column:
    return F.struct(F.lit(stage).alias("stage"), *[known.get(c, F.lit(0)).cast("int").alias(c) for c in SCALARS])


def for_each_country(facts: DataFrame, countries: DataFrame) -> DataFrame:
    """Every row of ``facts`` with every ``country``, as asked. A short table of countries is told to every task; a longer
    one is cut into lists, which meet shares of the facts by an equi-join."""
    if few(countries, BROADCAST_COUNTRIES):
        return facts.crossJoin(F.broadcast(countries))
    placed = row_number(countries.withColumn("whole", F.lit(0)), ["whole"], ["country"], "place")
    lists = kept(placed.groupBy(F.floor((F.col("place") - 1) / COUNTRIES_IN_LIST).cast("int").alias("list")).agg(F.collect_list("country").alias("names")), "countries")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = facts.withColumn("share", F.pmod(F.xxhash64("trajectory_id"), F.lit(SHARES)).cast("int")).withColumn("list", every(lists.count()))
    met = dealt.join(lists.withColumn("share", every(SHARES)), ["list", "share"])
    return met.withColumn("country", F.explode("names")).drop("list", "share", "names")


def episodes(trajectories: DataFrame, countries: DataFrame) -> DataFrame:
    """(trajectory_id, country, t, state, action, next_state, reward, done): three steps per trajectory and country.

    trajectories: trajectory_id, topic_id, sponsors, committee and plenary structs of name arrays (yes, no, abstain),
    final_outcome (null: adopted); one without sponsors, committee or plenary vote gives no episode. Every trajectory has
    an episode for each country, however many there are. What countries do is joined in long form, one row for
    each listed name; a country that a vote does not list abstains. Texts and titles stay with the trajectory.

    The state of the draft stage is left twice: before and after sponsors join (t = 0 and 1). Each vote then shows in the
    state behind it (t = 3 and 4); the state in which the committee votes (t = 2) is no result of a step.
    """
    whole = trajectories.filter("sponsors is not null and committee is not null and plenary is not null")
    dimension = kept(countries.select("country").filter("country is not null").distinct(), "countries")
    said = lambda a, at, code: F.transform(a, lambda x: F.struct(x.alias("country"), F.lit(at).alias("at"), F.lit(code).alias("action")))
    names = [said(F.col("sponsors"), "sponsor", COSPONSOR)] + [said(F.col(f"{at}.{k}"), at, code) for at in ("committee", "plenary") for k, code in LISTS.items()]
    empty = F.array().cast("array<struct<country:string,at:string,action:int>>")
    told = whole.select("trajectory_id", F.explode(F.concat(*[F.coalesce(n, empty) for n in names])).alias("x")).select("trajectory_id", "x.*").join(dimension, "country", "left_semi")
    # A country in several lists of one vote counts in the first of them.
    did = told.groupBy("trajectory_id", "country").agg(F.bool_or(F.col("at") == "sponsor").alias("sponsor"), *[F.min(F.when(F.col("at") == at, F.col("action"))).alias(at) for at in ("committee", "plenary")])
    n = lambda stage, k: F.coalesce(F.array_size(F.col(f"{stage}.{k}")), F.lit(0)).alias(f"{stage}_{k}")
    facts = whole.select("trajectory_id", "topic_id", F.size("sponsors").alias("sponsor_count"), F.coalesce("final_outcome", F.lit("adopted")).alias("outcome"), *[n(s, k) for s in ("committee", "plenary") for k in LISTS])
    rows = for_each_country(facts, dimension).join(did, ["trajectory_id", "country"], "left")
    is_sponsor = F.coalesce("sponsor", F.lit(False))
    base = {"topic_id": F.col("topic_id"), "sponsor_count": F.col("sponsor_count")}
    joined = {**base, "agent_is_sponsor": is_sponsor}
    committee, plenary = ({f"{s}_{k}": F.col(f"{s}_{k}") for k in LISTS} for s in ("committee", "plenary"))
    s0 = state(0, **base, t=F.lit(0))
    s1 = state(0, **joined, t=F.lit(1))
    s3 = state(2, **joined, **committee, t=F.lit(3))
    s4 = state(3, **joined, **committee, **plenary, t=F.lit(4))
    first = F.when(is_sponsor, COSPONSOR).otherwise(NO_ACTION)
    act = lambda at: F.coalesce(at, F.lit(VOTE_ABSTAIN))
    steps = [(s0, first, s1, F.lit(0.0), False), (s1, act("committee"), s3, F.lit(0.0), False), (s3, act("plenary"), s4, reward(is_sponsor, F.col("outcome")), True)]
    made = F.array(*[F.struct(F.lit(t).alias("t"), a.alias("state"), b.alias("action"), d.alias("next_state"), r.alias("reward"), F.lit(e).alias("done")) for t, (a, b, d, r, e) in enumerate(steps)])
    return rows.select("trajectory_id", "country", F.explode(made).alias("s")).select("trajectory_id", "country", "s.*")


def state_vector(s: Column) -> Column:
    """Four stage flags, then the ten numbers."""
    return F.array(*[F.when(s["stage"] == k, 1.0).otherwise(0.0) for k in range(4)], *[s[c].cast("double") for c in SCALARS])


def state_from_vector(v: Column) -> Column:
    """The stage is that of the first largest flag."""
    flags = F.slice(v, 1, 4)
    stage = (F.array_position(flags, F.array_max(flags)) - 1).cast("int")
    return F.struct(stage.alias("stage"), *[F.element_at(v, 5 + i).cast("int").alias(c) for i, c in enumerate(SCALARS)])


def valid_action(stage: Column, action: Column) -> Column:
    """J21."""
    out = F.lit(False)
    for k, actions in VALID.items():
        out = out | ((stage == k) & action.isin(*actions))
    return out


def episode_stats(steps: DataFrame, keys: list[str], value: str = "reward", is_sponsor: Column | None = None) -> DataFrame:
    """Episodes, transitions, mean length; mean, population deviation and signs of rewards over transitions; share of
    episodes in which ``is_sponsor`` holds somewhere."""
    r = F.col(value)
    each = steps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("length"), F.count(r).alias("n"), F.sum(r).alias("s"), F.sum(r * r).alias("q"), F.count_if(r > 0).alias("up"), F.count_if(r < 0).alias("down"),
        F.bool_or(F.coalesce(is_sponsor, F.lit(False)) if is_sponsor is not None else F.lit(False)).alias("sponsor"),
    )
    n = F.nullif(F.sum("n"), F.lit(0))
    mean = F.sum("s") / n
    return each.agg(
        F.count(F.lit(1)).alias("episodes"), F.coalesce(F.sum("length"), F.lit(0)).alias("transitions"), F.avg("length").alias("mean_length"), mean.alias("reward_mean"),
        F.sqrt(F.greatest(F.sum("q") / n - mean * mean, F.lit(0.0))).alias("reward_std"), F.coalesce(F.sum("up"), F.lit(0)).alias("positive"), F.coalesce(F.sum("down"), F.lit(0)).alias("negative"), F.avg(F.col("sponsor").cast("int")).alias("sponsor_rate"),
    )


def action_distribution(steps: DataFrame, action: str = "action") -> DataFrame:
    """J22."""
    return steps.groupBy(action).agg(F.count(F.lit(1)).alias("n"))


def action_share(steps: DataFrame, key: str, action: str) -> DataFrame:
    """Each action's share of a key's actions, in percent."""
    counts = steps.groupBy(key, action).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(key)), 4))


def compare_trajectories(real: DataFrame, simulated: DataFrame, key: str = "episode") -> DataFrame:
    """Per episode: share of equal actions by position, whether outcomes agree in sign, difference of lengths."""
    last = lambda df, p: df.groupBy(key).agg(F.count(F.lit(1)).alias(f"{p}_len"), F.max_by("reward", "t").alias(f"{p}_last"))
    equal = real.select(key, "t", F.col("action").alias("a")).join(simulated.select(key, "t", F.col("action").alias("b")), [key, "t"]).groupBy(key).agg(F.count_if(F.col("a") == F.col("b")).alias("equal"))
    both = last(real, "real").join(last(simulated, "sim"), key, "full_outer").join(equal, key, "left").fillna(0, ["real_len", "sim_len", "equal"])
    return both.select(key, (F.col("equal") / F.greatest("real_len", F.lit(1))).alias("action_accuracy"), ((F.coalesce("real_last", F.lit(0.0)) > 0) == (F.coalesce("sim_last", F.lit(0.0)) > 0)).alias("outcome_match"), F.abs(F.col("real_len") - F.col("sim_len")).alias("length_diff"))


def prediction_metrics(df: DataFrame, pred: str, target: str, few: int = 10) -> DataFrame:
    """Mse and rmse over all numbers, n of rows; mean over dimensions with fewer than ten distinct targets of the share of
    rounded predictions that equal them (null where no dimension is such)."""
    z = df.select(F.posexplode(F.arrays_zip(F.col(pred).alias("p"), F.col(target).alias("q"))).alias("dim", "x")).select("dim", F.col("x.p").alias("p"), F.col("x.q").alias("q"))
    per = z.groupBy("dim").agg(F.sum(F.pow(F.col("p") - F.col("q"), 2)).alias("sq"), F.count(F.lit(1)).alias("n"), F.countDistinct("q").alias("values"), F.avg((F.bround("p") == F.col("q")).cast("int")).alias("accuracy"))
    mse = F.sum("sq") / F.sum("n")
    return per.agg(mse.alias("mse"), F.sqrt(mse).alias("rmse"), F.avg(F.when(F.col("values") < few, F.col("accuracy"))).alias("mean_accuracy"), F.max("n").alias("n"))


def policy_metrics(df: DataFrame, key: str = "episode", pred: str = "predicted", expert: str = "expert", value: str = "reward") -> DataFrame:
    """Mean and population deviation, over episodes, of accuracy against the expert and of return."""
    each = df.groupBy(key).agg(F.avg((F.col(pred) == F.col(expert)).cast("int")).alias("accuracy"), F.sum(value).alias("total"))
    return each.agg(F.avg("accuracy").alias("accuracy_mean"), F.stddev_pop("accuracy").alias("accuracy_std"), F.avg("total").alias("return_mean"), F.stddev_pop("total").alias("return_std"), F.count(F.lit(1)).alias("episodes"))


def irl_features(v: Column) -> Column:
    """The seven features of a state vector."""
    at = lambda i: F.element_at(v, i + 1)
    return F.struct(
        at(6).alias("is_sponsor"), at(5).alias("sponsor_count"), (at(7) - at(8)).alias("committee_support"), (at(10) - at(11)).alias("plenary_support"), at(0).alias("in_draft"), at(1).alias("in_committee"), at(2).alias("in_plenary")
    )


FEATURES = ["is_sponsor", "sponsor_count", "committee_support", "plenary_support", "in_draft", "in_committee", "in_plenary"]


def feature_expectations(df: DataFrame, features: str = "features") -> DataFrame:
    """Means of the features."""
    return df.agg(*[F.avg(F.col(f"{features}.{c}")).alias(c) for c in FEATURES])


def fit_reward(df: DataFrame, features: str = "features", value: str = "reward", regularization: float = 1e-6) -> dict[str, float]:
    """Least-squares weights of the reward on the features, without intercept, by MLlib (a gradient descent on raw
    features diverges, so features are standardised there)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    flat = df.select(*[F.col(f"{features}.{c}").cast("double").alias(c) for c in FEATURES], F.col(value).cast("double").alias("label"))
    ready = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(flat)
    model = LinearRegression(featuresCol="x", fitIntercept=False, standardization=True, regParam=regularization).fit(ready)
    return dict(zip(FEATURES, model.coefficients.toArray().tolist()))


def holdout_last(df: DataFrame, keys: list[str], t: str = "t") -> DataFrame:
    """is_test marks the last transition of each key."""
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(t)))
    return df.withColumn("is_test", last == 1)
