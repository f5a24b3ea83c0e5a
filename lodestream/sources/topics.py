"""JSON topics: typed reading with a dead-letter side, and keyed writing.

format is an argument: "kafka" where its connector is installed, otherwise a
folder of files with key and value columns. Consumer offsets and delivery are
the stream's checkpointLocation and startingOffsets.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestream import schemas
from lodestream.functions.clock import in_utc, utc_clock
from lodestream.functions.text import is_uuid

# fixed values: topic names
ACTION_TOPIC = "user_actions"
FEATURE_TOPIC = "features"
TRAINING_TOPIC = "training_examples"

# the key column of each record
KEYS = {ACTION_TOPIC: "user_id", FEATURE_TOPIC: "id", TRAINING_TOPIC: "user_id"}
LAYOUTS = {
    ACTION_TOPIC: schemas.user_action,
    FEATURE_TOPIC: schemas.feature_vector,
    TRAINING_TOPIC: schemas.training_example,
}

# fixed values: the wire name of the time, and the fields that hold JSON themselves
WIRE_TIME = "timestamp"
JSON_FIELDS = ("context", "metadata")
OPTIONAL = ("context",)
IDS = ("user_id", "item_id", "id")
BROKEN = "_broken"


def read_topic(spark: SparkSession, topic: str, path_or_servers: str, format: str = "parquet", stream: bool = True, **options):
    """Raw (key, value) records of a topic, from the earliest offset."""
    reader = spark.readStream if stream else spark.read
    if format == "kafka":
        source = reader.format("kafka").option("kafka.bootstrap.servers", path_or_servers)
        source = source.option("subscribe", topic).option("startingOffsets", "earliest").options(**options)
        return source.load().select(F.col("key").cast("string"), F.col("value").cast("string"))
    source = reader.format(format).schema("key string, value string").options(**options)
    return source.load(f"{path_or_servers.rstrip('/')}/{topic}")


def wire_time(ts) -> Column:
    """RFC 3339 text of a UTC time in TIMESTAMP_NTZ; formatting it as a TIMESTAMP would bend it by the session's zone."""
    text = (F.col(ts) if isinstance(ts, str) else ts).cast("string")
    return F.concat(text.substr(1, 10), F.lit("T"), text.substr(12, 8), F.lit("."), F.rpad(text.substr(21, 6), 6, "0"), F.lit("Z"))


def utc_time(text) -> Column:
    """UTC time of RFC 3339 text; null if it is none, as without a zone."""
    zoned = F.when(text.rlike("(Z|[+-][0-9]{2}:?[0-9]{2})$"), text)
    return utc_clock(F.try_to_timestamp(zoned))


def decode(raw: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(records, dead letters). A null value is skipped; text that is not such a record is a dead letter.

    A record has every field of its layout but those of OPTIONAL, ids that are
    UUIDs where the layout has them as text, and no null inside a vector.
    Other columns of raw, such as an offset, are kept in front.
    """
    kept = [c for c in raw.columns if c not in ("key", "value")]
    wire = [T.StructField(WIRE_TIME, T.StringType()) if f.name == "ts" else f for f in schema.fields]
    with_broken = T.StructType([*wire, T.StructField(BROKEN, T.StringType())])
    record = F.from_json("value", with_broken, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN})
    # an array of one row, so that a record is made and parsed once and not again in each condition on it
    parsed = raw.select(*kept, F.explode(F.array(F.struct("value", record.alias("record")))).alias("_parsed"))
    parsed = parsed.filter(F.col("_parsed.value").isNotNull()).select(*kept, "_parsed.value", "_parsed.record")
    time = utc_time(F.col(f"record.{WIRE_TIME}"))
    fields = {n: time if n == "ts" else F.col(f"record.{n}") for n in schema.names}
    fine = F.col("record").isNotNull() & F.col(f"record.{BROKEN}").isNull()
    for field in schema.fields:
        if field.name not in OPTIONAL:
            fine = fine & fields[field.name].isNotNull()
        if field.name in IDS and isinstance(field.dataType, T.StringType):
            fine = fine & is_uuid(fields[field.name])
        if isinstance(field.dataType, T.ArrayType):
            fine = fine & ~F.exists(fields[field.name], lambda x: x.isNull())
    if "action_type" in fields:
        fine = fine & fields["action_type"].isin(list(schemas.ACTION_WEIGHTS))
    fine = F.coalesce(fine, F.lit(False))
    records = parsed.filter(fine).select(*kept, *[c.alias(n) for n, c in fields.items()])
    return records, parsed.filter(~fine).select(*kept, "value")


def encode(records: DataFrame, topic: str) -> DataFrame:
    """(key, value) for a topic: the record as JSON under its id.

    Numbers go out as FLOAT, like the layout's, and JSON text as JSON.
    """
    layout = LAYOUTS[topic]()
    records = in_utc(records)
    floats = (T.FloatType(), T.ArrayType(T.FloatType()))

    def sent(name):
        if name == "ts":
            return wire_time("ts").alias(WIRE_TIME)
        if name in JSON_FIELDS:
            return F.parse_json(F.col(name).cast("string")).alias(name)
        return F.col(name).cast(layout[name].dataType).alias(name) if layout[name].dataType in floats else F.col(name)

    fields = [sent(n) for n in layout.names if n in records.columns]
    return records.select(F.col(KEYS[topic]).cast("string").alias("key"), F.to_json(F.struct(*fields)).alias("value"))


def write_topic(encoded: DataFrame, topic: str, path_or_servers: str, checkpoint: str, format: str = "parquet", **trigger):
    """Start a query that appends (key, value) to a topic."""
    writer = encoded.writeStream.option("checkpointLocation", checkpoint).outputMode("append")
    if format == "kafka":
        writer = writer.format("kafka").option("kafka.bootstrap.servers", path_or_servers).option("topic", topic)
        return writer.trigger(**(trigger or {"availableNow": True})).start()
    return writer.format(format).trigger(**(trigger or {"availableNow": True})).start(
        f"{path_or_servers.rstrip('/')}/{topic}"
    )
