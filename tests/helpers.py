"""Row builders for the tests."""

from pyspark.sql import functions as F

from tidewell.model import FEED_SCHEMA

RECORD = (
    "struct<id:string,title:string,body:string,sender:string,sender_name:string,"
    "receiver:string,receiver_name:string,cc:string,sent_at:string,"
    "read_yn:boolean,has_attachment:boolean>"
)

GOOD = {
    "id": None,
    "title": "Hello",
    "body": "Some text",
    "sender": "a@x.example",
    "sender_name": "Ann",
    "receiver": "b@y.example",
    "receiver_name": "",
    "cc": None,
    "sent_at": "2025-05-21T09:00:00",
    "read_yn": True,
    "has_attachment": False,
}


def feed(spark, values, epoch=None):
    """Messages in arrival order; values are text, bytes or None."""
    rows = []
    for i, v in enumerate(values):
        data = None if v is None else bytearray(v if isinstance(v, bytes) else v.encode())
        rows.append((None, data, 0, i, None))
    df = spark.createDataFrame(rows, FEED_SCHEMA)
    return df if epoch is None else df.withColumn("epoch_id", F.lit(epoch).cast("bigint"))


def source(spark, records):
    """``records``: lookup id -> overrides of GOOD, or None for a null record."""
    schema = f"lookup_id string, record {RECORD}, fetch_error string, response_error string"
    names = list(GOOD)
    rows = []
    for ident, change in records.items():
        if change is None:
            rows.append((ident, None, None, None))
            continue
        change = dict(change)
        fetch, answer = change.pop("fetch_error", None), change.pop("response_error", None)
        full = {**GOOD, "id": ident, **change}
        rows.append((ident, tuple(full[n] for n in names), fetch, answer))
    return spark.createDataFrame(rows, schema)


def versions(spark, stored):
    return spark.createDataFrame(list(stored.items()), "mail_id string, event_version bigint")
