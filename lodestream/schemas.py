"""Record layouts shared by sources, operators and streams.

Ids are strings in the JSON layouts' natural form; the operators never look
inside them, so a table keyed by BIGINT works the same way.
"""

from pyspark.sql import types as T

DIM = 128

# fixed values: the action variants, in feature-vector order, and the label / weight each one carries
ACTION_WEIGHTS = {
    "View": 0.1,
    "Click": 0.3,
    "Like": 0.7,
    "Share": 0.8,
    "Purchase": 1.0,
    "Convert": 1.0,
}

NIL_UUID = "00000000-0000-0000-0000-000000000000"


def _struct(id_type, **fields):
    kinds = {
        "id": id_type,
        "text": T.StringType(),
        "vector": T.ArrayType(T.FloatType()),
        "float": T.FloatType(),
        "ts": T.TimestampNTZType(),
    }
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in fields.items()])


def user_action(id_type=T.StringType()):
    return _struct(id_type, user_id="id", item_id="id", action_type="text", ts="ts", context="text")


def training_example(id_type=T.StringType()):
    return _struct(
        id_type,
        user_id="id",
        item_id="id",
        label="float",
        user_features="vector",
        item_features="vector",
        context_features="vector",
        ts="ts",
    )


def feature_vector(id_type=T.StringType()):
    return _struct(id_type, id="id", vector="vector", metadata="text")
