"""Edit cost of candidate pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmatch.config import EditCosts
from quillmatch.functions.edit import costs as edit_costs
from quillmatch.functions.edit import in_blocks
from quillmatch.functions.scores import diff_word

FIRST = 0x4E00
SMALL = 250
#: Segments of more tokens are beyond the alphabet.
LETTERS = 20_000


def alphabet(size: int) -> str:
    """Characters that each are one code point and one UTF-16 unit."""
    return "".join(map(chr, range(FIRST, FIRST + size + 1)))


def marks(norm: Column, segment: Column, letters: Column) -> Column:
    """norm as text of one character for each token: its first place in the segment, or the mark of all that the segment doesn't have.

    A token equals one of the segment or none of it, so the segment's tokens are all that must be told apart, however long the query is.
    """
    at = lambda w: F.array_position(segment, w) + 1
    small = F.array_join(F.transform(norm, lambda w: F.chr(at(w))), "")
    large = F.array_join(F.transform(norm, lambda w: F.substring(letters, at(w).cast("int"), 1)), "")
    return F.when(F.size(segment) <= SMALL, small).otherwise(large)


def unit_cost(pairs: DataFrame, max_tokens: int, fuzzy: float | None = None) -> DataFrame:
    """pairs with cost: diff_word added up once for each edit, for pairs without real forms and dropped tokens.

    With fuzzy, the distance stops one edit beyond what that score allows, and such pairs are left out. Segments have at most max_tokens tokens, of at most LETTERS; queries may be longer.
    """
    letters = F.lit(alphabet(max_tokens))
    q, s = marks(F.col("q_norm"), F.col("s_norm"), letters), marks(F.col("s_norm"), F.col("s_norm"), letters)
    if fuzzy is None:
        return steps_cost(pairs.withColumn("_steps", F.levenshtein(q, s)))
    most = F.greatest(F.lit(0), F.ceil((1 - fuzzy) * F.greatest("p", "len")).cast("int") + 1)
    stopped = F.call_function("levenshtein", q, s, most)
    return steps_cost(pairs.withColumn("_steps", stopped))


def steps_cost(pairs: DataFrame) -> DataFrame:
    """pairs with cost for _steps, the number of edits; negative ones stand for too many."""
    dw, zero = diff_word(F.col("p"), F.col("len"), EditCosts()), F.lit(0.0).cast("float")
    total = F.when(F.col("_steps") > 0, F.aggregate(F.sequence(F.lit(1), F.col("_steps")), zero, lambda a, _: (a + dw).cast("float"))).when(F.col("_steps") == 0, zero)
    return pairs.withColumn("cost", total).drop("_steps")


def weighted_cost(pairs: DataFrame, c: EditCosts, idf_weight: float = 0.0, idf_max: float = 1.0, fuzzy: float | None = None) -> DataFrame:
    """pairs with cost, in Arrow batches. With idf_weight, pairs have `idf`, numbers for the query's tokens. With fuzzy, the cost is null where it shows early that this score isn't reached."""
    most = np.inf if fuzzy is None else (1 - fuzzy) * 100 + 0.1  # far beyond rounding
    names = pairs.columns
    schema = T.StructType([*pairs.schema.fields, T.StructField("cost", T.FloatType())])

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            col = lambda n: b.column(names.index(n))  # noqa: B023, E731
            out = np.zeros(b.num_rows, np.float32)
            for at in in_blocks(col("p").to_numpy(zero_copy_only=False), col("len").to_numpy(zero_copy_only=False)):
                take = pa.array(at)
                six = [col(n).take(take) for n in ("q_norm", "q_real", "q_itoks", "s_norm", "s_real", "s_itoks")]
                more = (col("idf").take(take), idf_weight, idf_max) if idf_weight else ()
                out[at] = edit_costs(*six, c, *more, most=most)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, mask=np.isinf(out))], names=schema.names)

    return pairs.mapInArrow(run, schema)
