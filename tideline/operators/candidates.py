"""The vector a candidate action is judged by: the causal pack's 128 features and 42 of the candidate itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.scalar import break_even, logit, sigmoid

#: Width of the causal pack; its columns are f_000 and so on.
PACK = 128
#: Names and order of the candidate's features.
NAMES = (
    "outcome.terminal_logit", "outcome.uncertainty_log_scale",
    *(f"portfolio.{i}" for i in range(9)), *(f"prediction_memory.{i}" for i in range(7)),
    "base.logit_call0", "base.logit_call1", "base.logit_skip", "base.protocol_value_call0", "base.protocol_value_call1", "base.protocol_value_skip",
    "execution.entry_price_call0", "execution.entry_price_call1", "execution.payout_call0", "execution.payout_call1", "execution.market_probability_call0", "execution.market_probability_call1",
    "candidate.side_call0", "candidate.side_call1", "candidate.entry_price", "candidate.opposite_entry_price", "candidate.payout", "candidate.break_even_probability", "candidate.market_probability",
    "candidate.terminal_probability", "candidate.market_edge", "candidate.terminal_edge", "candidate.price_logit", "candidate.upside_per_cost",
)
WIDTH = PACK + len(NAMES)
#: What describes a candidate: arrays with their lengths, and single values (length 0).
INPUTS = {"terminal_logit": 0, "uncertainty_log_scale": 0, "portfolio": 9, "prediction_memory": 7, "base_logits": 3, "protocol_values": 3, "entry_prices": 2, "payouts": 2, "market_probabilities": 2, "action": 0}


def features() -> dict[str, Column]:
    """The candidate's features by name, in their order, from the INPUTS columns; action is 0 or 1."""
    action = F.col("action").cast("int")

    def at(c: str, i: Column | int) -> Column:
        return F.get(F.col(c), i if isinstance(i, Column) else F.lit(i)).cast("double")

    price, payout, market = at("entry_prices", action), at("payouts", action), at("market_probabilities", action)
    yes = sigmoid(F.least(F.greatest(F.col("terminal_logit"), F.lit(-30.0)), F.lit(30.0)))
    terminal, even = F.when(action == 0, yes).otherwise(1 - yes), break_even(payout)
    values = [
        F.col("terminal_logit"), F.col("uncertainty_log_scale"), *(at("portfolio", i) for i in range(9)), *(at("prediction_memory", i) for i in range(7)), *(at("base_logits", i) for i in range(3)), *(at("protocol_values", i) for i in range(3)),
        *(at(c, i) for c in ("entry_prices", "payouts", "market_probabilities") for i in (0, 1)), (action == 0).cast("double"), (action == 1).cast("double"),
        price, at("entry_prices", 1 - action), payout, even, market, terminal, market - even, terminal - even, logit(price, 1e-6), payout - 1,
    ]
    if len(values) != len(NAMES):
        raise ValueError("candidate features do not match their names")
    return dict(zip(NAMES, values))


def aligned() -> Column:
    """Whether the inputs have their lengths and the action is 0 or 1; a null input is not aligned."""
    ok = F.coalesce(F.col("action").isin(0, 1), F.lit(False))
    for name, n in INPUTS.items():
        ok = ok & (F.coalesce(F.size(name) == n, F.lit(False)) if n else F.col(name).isNotNull())
    return ok


def _names(pack: DataFrame) -> list[str]:
    names = [f"f_{i:03d}" for i in range(PACK)]
    if [c for c in pack.columns if c.startswith("f_")] != names:
        raise ValueError(f"the pack must have {PACK} features in their order")
    return names


def assemble(pack: DataFrame, inputs: DataFrame, key: str = "trade_id") -> DataFrame:
    """key and vector (WIDTH floats, in order) of every candidate; an input that is not aligned, a row without its pack, or a value that is not finite is an error.

    inputs(key, INPUTS..) may hold several candidates of a key.
    """
    return _vectors(inputs.join(pack.select(key, F.array(*_names(pack)).alias("_pack")), key, "left"), key, F.col("_pack"))


def in_place(pack: DataFrame, inputs: dict[str, Column], key: str = "trade_id") -> DataFrame:
    """As assemble(), of one candidate a row of the pack, whose inputs are made from columns of that row: nothing is joined."""
    # columns, not one array: Spark compiles a wide projection in parts, and an array of 128 expressions as one slow method
    names = _names(pack)
    return _vectors(pack.select(key, *names, *(v.alias(c) for c, v in inputs.items())), key, F.array(*names))


def _finite(v: Column) -> Column:
    """Whether no value is null, NaN or infinite: a search that meets a null finds null, and NaN is the greatest."""
    inf = F.lit(float("inf")).cast("float")
    return F.coalesce(~F.array_contains(v, -inf), F.lit(False)) & F.coalesce(F.array_max(v) < inf, F.lit(False))


def _vectors(rows: DataFrame, key: str, pack: Column) -> DataFrame:
    vector = F.concat(pack, F.array(*(v.cast("float") for v in features().values())))
    sound = aligned() & F.coalesce(F.size(pack) == PACK, F.lit(False)) & _finite(vector)
    problem = F.raise_error(F.concat(F.lit("no sound candidate vector for "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return rows.select(key, "action", F.when(sound, vector).otherwise(problem.cast("array<float>")).alias("vector"))
