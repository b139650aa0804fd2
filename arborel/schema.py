"""Column sets of the tables that the operators exchange; never inferred."""

from pyspark.sql import types as T

#: A point: metres, and the same in whole centimetres, in which distances are exact.
POINT = T.StructType(
    [
        T.StructField("point_id", T.LongType(), False),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("z", T.DoubleType()),
        T.StructField("classification", T.IntegerType()),
        T.StructField("withheld", T.BooleanType()),
        T.StructField("treeID", T.LongType()),
    ]
)
RASTER = T.StructType([T.StructField("col", T.LongType()), T.StructField("row", T.LongType()), T.StructField("z", T.DoubleType())])
TREETOP = T.StructType([T.StructField("treeID", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in "xyz")])
METRICS = T.StructType(
    [
        T.StructField("tile", T.IntegerType()),
        *(T.StructField(c, T.LongType()) for c in ("true_positives", "false_positives", "false_negatives")),
        *(T.StructField(c, T.DoubleType()) for c in ("precision", "recall", "f1_score")),
    ]
)
#: Codes of the classification column that matter here.
GROUND, NOISE = 2, 18
#: treeID of ground points; null means unassigned.
GROUND_TREE = 0
