"""User bins' elements as a table function, for SQL's LATERAL."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from sketchloom.functions import kmers


class SequenceElements:
    """``user_bin_elements(seq, k, window)``: the distinct k-mers, or minimisers, of a sequence."""

    @staticmethod
    def analyze(seq: AnalyzeArgument, k: AnalyzeArgument, window: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(seq.dataType, StringType):
            raise ValueError("the sequence must be a string")
        if not all(isinstance(x.dataType, (IntegerType, LongType)) and x.isConstantExpression and x.value is not None for x in (k, window)):
            raise ValueError("k and window must be whole constants")
        if k.value > window.value:
            raise ValueError("The k-mer size cannot be bigger than the window size.")
        kmers.adjusted_seed(k.value)
        return AnalyzeResult(schema=StructType().add("h", LongType()))

    def eval(self, seq, k, window):
        codes = kmers.CODES[np.frombuffer((seq or "").encode(), np.uint8)]
        for h in np.unique(kmers.windows(codes, k, window, True)).view(np.int64).tolist():
            yield (h,)


def register(spark: SparkSession) -> None:
    spark.udtf.register("user_bin_elements", udtf(SequenceElements))


def register_source(spark: SparkSession, name: str, source: Callable[[int], Iterable[int]]) -> None:
    """``name(ub_id)`` in SQL: the elements that a function gives for a user bin."""

    class Elements:
        @staticmethod
        def analyze(ub_id: AnalyzeArgument) -> AnalyzeResult:
            if not isinstance(ub_id.dataType, (IntegerType, LongType)):
                raise ValueError("a user bin is a whole number")
            return AnalyzeResult(schema=StructType().add("h", LongType()))

        def eval(self, ub_id):
            for h in source(ub_id):
                yield (kmers.signed(int(h)),)

    spark.udtf.register(name, udtf(Elements))
