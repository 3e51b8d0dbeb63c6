"""The registered queries over the driver tables, each with its SQL for comparison.

Feed: one message per row of ``events``; the user is the mail, ``error`` means
removal, the number in ``props`` is the version, the day is the epoch.
Source: one row per row of ``documents``; the sender is the customer of the same
number.  German documents answer to another id, unlabelled French ones fail to
be fetched, unlabelled Spanish ones answer with an error.  A toxic label spoils
the sender's address, and the customer's nation and balance decide which other
field is spoiled (``SPOILED``), so that every message occurs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.domains.mail import MAIL
from tidewell.functions import text as X
from tidewell.functions.bind import bind
from tidewell.functions.coerce import collapse_space, iso_text, iso_timestamp
from tidewell.functions.envelope import FieldKey, decrypt_fields, encrypt_fields
from tidewell.operators import activity, enrich, fanout, merge, outcomes, parse, redrive, serving
from tidewell.operators.latest import latest_per_key
from tidewell.plans import history
from tidewell.plans.ingest import process
from tidewell.session import prepare
from tidewell.sources.lake import Lake
from tidewell.sources.storage import shared_dir
from tidewell.streaming.ingest import ingest_epoch

EPOCH_ZERO = "1970-01-01"
CONSUMERS = ("click", "view", "signup", "purchase", "error")
TOPICS = ("search-events", "mobile-events", "graph-events")
#: A key for the comparison queries only; jobs read theirs from the environment.
QUERY_KEY = FieldKey("comparison", bytes(range(32)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def number_in_props() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def moment() -> Column:
    return F.col("ts").cast("timestamp")


def micros_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def _event_body() -> Column:
    action = F.when(F.col("event_type") == "error", F.lit("removed")).otherwise(F.col("event_type"))
    return F.to_json(
        F.struct(
            F.col("user_id").cast("string").alias("mail_id"),
            action.alias("action"),
            number_in_props().alias("version"),
            iso_text(moment()).alias("occurred_at"),
        )
    )


def _as_contract(events: DataFrame, value: Column) -> DataFrame:
    return bind(events, "value_text", value).select(
        F.lit(None).cast("binary").alias("key"),
        F.col("value_text").cast("binary").alias("value"),
        F.lit(0).alias("partition"),
        F.col("event_id").alias("offset"),
        moment().alias("timestamp"),
        F.date_diff(moment().cast("date"), F.lit(EPOCH_ZERO).cast("date")).cast("bigint").alias("epoch_id"),
    )


def spread(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table dealt out anew by its key: it is a few large row groups, and what is done to a row is far dearer than moving it."""
    return table(spark, sf_dir, name).repartition(key)


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_contract(spread(spark, sf_dir, "events", "event_id"), _event_body())


def damaged_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same feed where single-digit numbers spoil the message, each in its own way."""
    k = F.col("number")
    good = F.col("good")
    ident = F.col("user_id").cast("string")
    value = (
        F.when(k == 0, F.concat(good, F.lit(" trailing")))
        .when(k == 1, F.substring(good, 1, 12))
        .when(k == 2, F.concat(F.lit("["), good, F.lit("]")))
        .when(k == 3, F.replace(good, F.lit('"mail_id"'), F.lit('"other_id"')))
        .when(k == 4, F.concat(F.lit('{"mail_id":"  ","n":'), ident, F.lit("}")))
        .when(k == 5, F.concat(F.lit('{"mail_id":'), ident, F.lit(',"version":" 4 "}')))
        .when(k == 6, F.concat(F.lit('{"mail_id":"'), ident, F.lit('","action":" Deleted ","version":"x"}')))
        .when(k == 7, F.concat(good, F.lit(","), good))
        .when(k == 8, F.concat(F.lit('{"mail_id":"'), ident, F.lit('","version":3.7,"occurred_at":"2025"}')))
        .otherwise(good)
    )
    events = spread(spark, sf_dir, "events", "event_id")
    return _as_contract(bind(bind(events, "number", number_in_props()), "good", _event_body()), value)


#: Nations whose customers' records are spoiled, each in its own way.
SPOILED = {
    "id": 0, "title": 1, "body": 2, "sender": 3, "no receiver": 4, "receiver": 5, "cc": 6, "sent_at": 7, "read_yn": 8,
    "has_attachment": 9, "empty title": 10, "empty body": 11, "tagged title": 12,
}


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    people = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("doc_id"), "c_custkey", "c_name", "c_mktsegment", "c_nationkey", "c_acctbal"
    )
    joined = docs.join(labels, "doc_id", "left").join(people, "doc_id", "left")
    ident = F.col("doc_id").cast("string")
    title = F.concat_ws(" ", "source", "lang")
    rich = F.col("c_acctbal") > 0

    def spoil(what: str, bad: Column, good: Column) -> Column:
        return F.when(F.col("c_nationkey") == SPOILED[what], bad).otherwise(good)

    at = F.when(F.col("toxic") == 1, F.lit(".at.")).otherwise(F.lit("@"))
    sender = F.concat(F.lit("c"), F.col("c_custkey").cast("string"), at, F.lower("c_mktsegment"), F.lit(".example"))
    receiver = F.concat(F.lit("r"), ident, F.lit("@corp.example"))
    nothing = F.lit(None).cast("string")
    tagged = F.concat(F.lit("<b>"), title, F.lit("</b>"))
    record = F.struct(
        spoil("id", F.when(rich, "").otherwise(ident), ident).alias("id"),
        spoil("title", F.lit(" "), spoil("empty title", F.lit("<i> </i>"), spoil("tagged title", tagged, title))).alias("title"),
        spoil("body", F.lit("\n"), spoil("empty body", F.lit("<p></p>"), F.col("text"))).alias("body"),
        spoil("sender", F.lit(""), sender).alias("sender"),
        F.col("c_name").alias("sender_name"),
        spoil("no receiver", nothing, spoil("receiver", F.concat(F.lit("r"), ident, F.lit(" at corp")), receiver)).alias("receiver"),
        F.lit("").alias("receiver_name"),
        spoil("cc", F.when(rich, "nobody").otherwise("cc@corp.example"), nothing).alias("cc"),
        spoil("sent_at", F.when(rich, "yesterday").otherwise("2025-05-21T09:00:00+09:00"), nothing).alias("sent_at"),
        spoil("read_yn", F.lit("true"), nothing).alias("read_yn"),
        spoil("has_attachment", F.lit("1"), nothing).alias("has_attachment"),
    )
    unlabelled = F.col("toxic").isNull()
    return joined.select(
        F.when(F.col("lang") == "de", F.concat(F.lit("de-"), ident)).otherwise(ident).alias("lookup_id"),
        record.alias("record"),
        F.when(unlabelled & (F.col("lang") == "fr"), "timeout").alias("fetch_error"),
        F.when(unlabelled & (F.col("lang") == "es"), "gone").alias("response_error"),
    )


# -- queries --------------------------------------------------------------


def parse_events(spark, sf_dir):
    rows = parse.parse_feed(damaged_feed(spark, sf_dir), MAIL)
    return rows.select(
        F.col("offset").alias("event_id"),
        "mail_id",
        F.when(F.col("parse_error").isNull(), F.col("action")).alias("action"),
        F.when(F.col("parse_error").isNull(), F.col("event_version")).alias("event_version"),
        micros_text(F.col("occurred_at")).alias("occurred_at"),
        "parse_error",
    )


def parse_moments(spark, sf_dir):
    """P6 over every event's time, in a form that its type decides."""
    at, kind = moment(), F.col("event_type")
    week = F.concat_ws(
        "-", F.extract(F.lit("YEAROFWEEK"), at).cast("string"),
        F.concat(F.lit("W"), F.lpad(F.weekofyear(at).cast("string"), 2, "0")), (F.weekday(at) + 1).cast("string"),
    )
    written = (
        F.when(kind == "click", F.date_format(at, "yyyyMMdd'T'HHmmss"))
        .when(kind == "view", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss,SSSSSS'789+09:00'"))
        .when(kind == "signup", week)
        .when(kind == "purchase", F.date_format(at, "yyyy-MM-dd'x'HH'-0930'"))
        .otherwise("yesterday")
    )
    rows = bind(table(spark, sf_dir, "events"), "written", written)
    return rows.select("event_id", micros_text(iso_timestamp(F.col("written"))).alias("read_at"))


def latest_event(spark, sf_dir):
    events = parse.usable(parse.parse_feed(feed(spark, sf_dir), MAIL, keep=("epoch_id",))).drop("payload_json")
    best = latest_per_key(events, MAIL, by=("epoch_id",))
    return best.select(
        "epoch_id", "mail_id", "action", "event_version", F.col("offset").alias("event_id"),
        micros_text(F.col("occurred_at")).alias("occurred_at"),
    )


def delete_ids(spark, sf_dir):
    events = parse.usable(parse.parse_feed(feed(spark, sf_dir), MAIL))
    return parse.delete_ids(events, MAIL)


def _winners(spark, sf_dir):
    return history.epoch_winners(feed(spark, sf_dir), MAIL)


def _last_upserts(spark, sf_dir):
    """The latest event per id over the whole feed, upserts only."""
    events = parse.usable(parse.parse_feed(feed(spark, sf_dir), MAIL)).drop("payload_json")
    return parse.upserts(latest_per_key(events, MAIL))


def enrich_claim_check(spark, sf_dir):
    found = enrich.lookup(_last_upserts(spark, sf_dir), source(spark, sf_dir), MAIL)
    return found.select(
        "mail_id", "event_version",
        F.col("record.title").alias("title"),
        F.md5(F.col("record.body").cast("binary")).alias("body_md5"),
        F.col("record.sender").alias("sender"),
        "lookup_error",
    )


def validate_reasons(spark, sf_dir):
    src = source(spark, sf_dir).withColumnRenamed("lookup_id", "mail_id")
    return enrich.validate(src, MAIL).select("mail_id", "rule_error")


def refine_pages(spark, sf_dir):
    pages = spread(spark, sf_dir, "pages", "page_id").select("page_id", "url", "html")
    return X.refine(pages, ["html"]).withColumnRenamed("html", "plain")


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def _refined_md5(docs: DataFrame, wrapped: Column) -> DataFrame:
    out = X.refine(docs.select("doc_id", wrapped.alias("text")), ["text"])
    return out.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def tagged_docs(spark, sf_dir):
    """Documents as pages: a quoted ">", a script, and a reference that was escaped twice."""
    docs = spread(spark, sf_dir, "documents", "doc_id").select("doc_id", "text")
    head, tail = '<html><body><p title="a>b">', "</p> <script>if (a < b) { }</script><!-- c --> <b>&amp;lt;</b>&#169;</body></html>"
    return _refined_md5(docs, F.concat(F.lit(head), _escaped(F.col("text")), F.lit(tail)))


def mime_docs(spark, sf_dir):
    """Documents as mails: the language decides the form; every form holds the same text."""
    docs = spread(spark, sf_dir, "documents", "doc_id").select("doc_id", "text", "lang")
    packed = F.base64(F.col("text").cast("binary"))
    plain = lambda body: F.concat(F.lit("Content-Type: text/plain; charset=utf-8\n\n"), body)
    page = F.concat(F.lit("Content-Type: text/html\n\n<p>"), _escaped(F.col("text")), F.lit("</p>"))
    coded = F.concat(F.lit("Content-Type: text/plain; charset=UTF-8\nContent-Transfer-Encoding: base64\n\n"), packed)

    def mail(*parts: Column) -> Column:
        pieces = [c for p in parts for c in (F.lit("--=_b\n"), p, F.lit("\n"))]
        return F.concat(F.lit('MIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="=_b"\n\n'), *pieces, F.lit("--=_b--\n"))

    wrapped = (
        F.when(F.col("lang") == "en", coded)
        .when(F.col("lang") == "fr", mail(F.lit("Content-Type: text/html\n\n<p>not this</p>"), plain(F.col("text"))))
        .when(F.col("lang") == "es", mail(plain(F.lit("")), page))
        .otherwise(mail(F.lit("Content-Type: image/png\n\nx"), coded))
    )
    return _refined_md5(docs, wrapped)


def deep_mime_docs(spark, sf_dir):
    """Documents as mails of several levels, in other character sets or below long headers; the language decides.

    Texts are cut to ASCII, which all those character sets share, and greet in
    the language of the set.
    """
    docs = spread(spark, sf_dir, "documents", "doc_id")
    docs = docs.select("doc_id", F.regexp_replace("text", r"[^\x00-\x7F]", "").alias("text"), "lang")

    def part(kind: str, charset: str, greeting: str) -> Column:
        said = F.concat(F.lit(greeting + " "), F.col("text") if kind == "text/plain" else _escaped(F.col("text")))
        packed = F.base64(F.call_function("encode", said, F.lit(charset)))
        head = f"Content-Type: {kind}; charset={charset}\nContent-Transfer-Encoding: base64\n\n"
        return F.concat(F.lit(head), packed)

    def nested(levels: int, inner: Column) -> Column:
        """Each level holds a picture, the next level, and another picture."""
        picture = F.lit("Content-Type: image/png\n\nx")
        for k in range(levels):
            line = F.lit(f"--=_{k}\n")
            pieces = [c for p in (picture, inner, picture) for c in (line, p, F.lit("\n"))]
            inner = F.concat(F.lit(f'Content-Type: multipart/mixed;\n boundary="=_{k}"\n\n'), *pieces, F.lit(f"--=_{k}--\n"))
        return F.concat(F.lit("MIME-Version: 1.0\n"), inner)

    receivers = "To: " + ",\n ".join(f"receiver-{k}@x.example" for k in range(400)) + "\n"
    wrapped = (
        F.when(F.col("lang") == "en", nested(3, part("text/plain", "EUC-KR", "안녕하세요")))
        .when(F.col("lang") == "fr", nested(5, part("text/html", "Shift_JIS", "<p>こんにちは</p>")))
        .when(F.col("lang") == "es", F.concat(F.lit("MIME-Version: 1.0\n" + receivers), part("text/plain", "ISO-2022-JP", "日本")))
        .otherwise(F.concat(F.lit("MIME-Version: 1.0\n" + receivers), nested(3, part("text/plain", "KOI8-R", "Привет"))))
    )
    return _refined_md5(docs, wrapped)


def whitespace_docs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.md5(collapse_space(F.col("text")).cast("binary")).alias("text_md5"))


def refine_docs(spark, sf_dir):
    docs = spread(spark, sf_dir, "documents", "doc_id").select("doc_id", "text")
    out = X.refine(docs, ["text"])
    return out.select("doc_id", F.length("text").alias("chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def protect_roundtrip(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.col("c_name").alias("sender_name"),
        F.concat(F.lower("c_mktsegment"), F.lit("@x.example")).alias("sender"),
        F.when(F.col("c_acctbal") < 0, F.lit("  ")).otherwise(F.col("c_mktsegment")).alias("cc"),
    )
    fields = ("sender", "sender_name", "cc")
    sealed = encrypt_fields(people, fields, QUERY_KEY)
    opened = decrypt_fields(sealed, fields, {QUERY_KEY.key_id: QUERY_KEY})
    return opened.select("c_custkey", *fields, F.col("cc_enc").isNull().alias("cc_blank"))


def _folded(rows):
    return rows.select(
        "epoch_id", "mail_id", "event_version", "current_version", "validation_error"
    )


def stale_events(spark, sf_dir):
    return _folded(history.stale_events(feed(spark, sf_dir), source(spark, sf_dir), MAIL))


def stale_events_in_runs(spark, sf_dir):
    """The same rows with histories cut into runs of eight epochs."""
    return _folded(history.stale_events(feed(spark, sf_dir), source(spark, sf_dir), MAIL, block=8))


def gold_state(spark, sf_dir):
    rows = history.gold_state(feed(spark, sf_dir), source(spark, sf_dir), MAIL)
    return rows.select(
        "mail_id", "title", "body", "sender", "sender_name", "receiver", "cc", "read_yn",
        "event_version", micros_text(F.col("occurred_at")).alias("occurred_at"),
    )


def _replayed(spark, sf_dir) -> Lake:
    """All events as three epochs through a lake of its own: the days of the month in thirds, whatever the month."""
    root = f"{shared_dir(spark).rstrip('/')}/lakes/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    lake, records = Lake(spark, root, MAIL).ensure(), source(spark, sf_dir)
    third = F.floor((F.dayofmonth("timestamp") - 1) / 11)
    for epoch in range(3):
        events = feed(spark, sf_dir).where(third == epoch).drop("epoch_id")
        ingest_epoch(MAIL, events, records, lake, QUERY_KEY, epoch)
        if epoch == 1:
            lake.compact(epoch)
    return lake


def lake_gold(spark, sf_dir):
    """The gold layer after three epochs, one of them compacted."""
    rows = decrypt_fields(_replayed(spark, sf_dir).state("gold"), MAIL.personal, {QUERY_KEY.key_id: QUERY_KEY})
    return rows.select(
        "mail_id", "title", F.md5(F.col("body").cast("binary")).alias("body_md5"), "sender", "receiver",
        "event_version", micros_text(F.col("occurred_at")).alias("occurred_at"),
    )


def lake_quarantine(spark, sf_dir):
    """What three epochs set aside."""
    return _replayed(spark, sf_dir).quarantine().select("epoch_id", "mail_id", "validation_error")


def _split_orders(spark, sf_dir):
    """Orders before and from a turning day on: what is stored, and what comes in."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    turn = F.lit("2001-06-01").cast("timestamp")
    day = F.col("o_orderdate").cast("timestamp")
    slim = orders.select("o_custkey", "o_orderkey", "o_orderstatus", day.alias("at"))
    columns = ["o_custkey", "o_orderkey", "o_orderstatus"]
    return slim.where(F.col("at") < turn).select(*columns), slim.where(F.col("at") >= turn).select(*columns)


def upsert_merge(spark, sf_dir):
    stored, incoming = _split_orders(spark, sf_dir)
    return merge.replace_by_ids(stored, incoming, "o_custkey")


def delete_apply(spark, sf_dir):
    stored, incoming = _split_orders(spark, sf_dir)
    return merge.delete_by_ids(stored, incoming.where(F.col("o_orderstatus") == "F"), "o_custkey")


def _stored_versions(spark, sf_dir):
    """A lake that already holds a version per customer."""
    people = table(spark, sf_dir, "customer")
    return people.select(
        F.col("c_custkey").cast("string").alias("mail_id"),
        # around the versions that last events reach: below, equal and above
        (F.col("c_nationkey") + 80).cast("bigint").alias("event_version"),
    )


def _batch(spark, sf_dir):
    """The whole damaged feed as one batch against the stored versions."""
    return process(
        MAIL, damaged_feed(spark, sf_dir), source(spark, sf_dir), _stored_versions(spark, sf_dir), QUERY_KEY
    )


def quarantine_union(spark, sf_dir):
    return _batch(spark, sf_dir).quarantine.select(
        "mail_id", "action", F.col("payload_json").isNull().alias("without_payload"),
        F.get_json_object("payload_json", "$.version").alias("payload_version"),
        F.get_json_object("raw_mail_json", "$.title").alias("record_title"),
        "validation_error",
    )


def ready_notices(spark, sf_dir):
    return _batch(spark, sf_dir).ready


def accepted_rows(spark, sf_dir):
    rows = _batch(spark, sf_dir).accepted
    opened = decrypt_fields(rows, ("sender", "receiver"), {QUERY_KEY.key_id: QUERY_KEY})
    return opened.select(
        "mail_id", "title", F.md5(F.col("body").cast("binary")).alias("body_md5"), "sender", "receiver",
        F.col("cc_enc").isNull().alias("cc_blank"), "event_version",
    )


def batch_metrics(spark, sf_dir):
    return _batch(spark, sf_dir).metrics


def epoch_counts(spark, sf_dir):
    """A3 per epoch over the history: winners and deletes."""
    return (
        _winners(spark, sf_dir)
        .groupBy("epoch_id")
        .agg(F.count("*").alias("events"), F.count_if(F.col("action") == "DELETE").alias("deleted"))
    )


def _letters(spark, sf_dir):
    """Dead letters in their wire form, made from events: the type gives the error, k the retries."""
    k = F.col("number")
    events = bind(table(spark, sf_dir, "events"), "number", number_in_props())
    payload = F.when(k >= 90, F.lit("not json")).otherwise(
        F.concat(
            F.lit('{"mail_id":"'), F.col("user_id").cast("string"), F.lit('","_retry_count":'),
            F.floor(k / 20).cast("string"), F.lit("}"),
        )
    )
    error = (
        F.when(F.col("event_type") == "click", F.lit("fetch failed: timeout"))
        .when(F.col("event_type") == "view", F.lit("FETCH FAILED reset"))
        .when(F.col("event_type") == "signup", F.lit("supply response error: not found"))
        .when(F.col("event_type") == "purchase", F.lit("title is required"))
    )
    quarantined = events.select(
        F.col("user_id").cast("string").alias("mail_id"),
        F.lit("UPSERT").alias("action"),
        payload.alias("payload_json"),
        F.lit(None).cast("string").alias("raw_mail_json"),
        error.alias("validation_error"),
        moment().alias("quarantined_at"),
        F.col("event_id").alias("offset"),
    )
    letters = outcomes.dead_letters(quarantined, MAIL)
    return redrive.classify(redrive.from_messages(redrive.to_messages(letters)), MAIL)


def dlq_outcomes(spark, sf_dir):
    return redrive.outcome_counts(_letters(spark, sf_dir))


def redriven_events(spark, sf_dir):
    """The re-driven messages as the ingest would parse them again."""
    sent = redrive.redriven(_letters(spark, sf_dir), MAIL)
    text = F.col("value").cast("string")
    return (
        sent.select(
            F.col("key").cast("string").alias("mail_key"),
            F.get_json_object(text, "$.mail_id").alias("mail_id"),
            F.get_json_object(text, "$.action").alias("action"),
            F.get_json_object(text, "$._retry_count").cast("int").alias("retry_count"),
        )
        .groupBy("mail_key", "mail_id", "action", "retry_count")
        .agg(F.count("*").alias("messages"))
    )


def parked_letters(spark, sf_dir):
    return (
        redrive.parked(_letters(spark, sf_dir))
        .groupBy("outcome", "validation_error")
        .agg(F.count("*").alias("letters"), F.countDistinct("entity_id").alias("mails"))
    )


def _gold(spark, sf_dir):
    """Stored rows: every record, with a version for those whose customer owes nothing."""
    src = source(spark, sf_dir)
    people = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("lookup_id"), "c_acctbal", "c_nationkey"
    )
    rich = src.join(people, "lookup_id", "left")
    stored = rich.select(
        F.col("lookup_id").alias("mail_id"),
        F.col("record.title").alias("title"),
        F.col("record.body").alias("body"),
        *(F.lit(None).cast("string").alias(f"{n}_enc") for n in MAIL.personal),
        F.lit(None).cast("timestamp").alias("sent_at"),
        F.when(F.col("c_acctbal") > 5000, F.lit(True)).alias("read_yn"),
        F.lit(None).cast("boolean").alias("has_attachment"),
        F.when(F.col("c_acctbal") > 0, F.col("c_nationkey").cast("bigint")).alias("event_version"),
        F.timestamp_seconds(F.col("c_nationkey") * 100000).alias("source_updated_at"),
        F.lit(None).cast("timestamp").alias("occurred_at"),
        F.lit(None).cast("timestamp").alias("ingested_at"),
    )
    return stored.select(*MAIL.table_schema.names)


def _served(df):
    return df.select(
        "mail_id",
        F.col("mail.title").alias("title"),
        F.md5(F.col("mail.body").cast("binary")).alias("body_md5"),
        F.col("mail.sender_enc").alias("sender_enc"),
        F.col("mail.read_yn").alias("read_yn"),
        F.col("mail.has_attachment").alias("has_attachment"),
        F.col("mail.event_version").alias("event_version"),
        F.col("mail.source_updated_at").alias("source_updated_at"),
        F.col("mail.occurred_at").alias("occurred_at"),
        "source",
    )


def serve_view(spark, sf_dir):
    return _served(serving.serve_view(_gold(spark, sf_dir), MAIL))


def serve_lookup(spark, sf_dir):
    return _served(serving.serve_lookup(_gold(spark, sf_dir), MAIL, "1"))


def fanout_topics(spark, sf_dir):
    fanned = fanout.fan_out(feed(spark, sf_dir), TOPICS)
    return fanned.select("topic", F.col("offset").alias("event_id"), F.get_json_object(F.col("value").cast("string"), "$.mail_id").alias("mail_id"))


def subscriber_records(spark, sf_dir):
    """One subscriber of the fan-out pulling records directly: hits and misses per mail."""
    mine = fanout.subscription(fanout.fan_out(feed(spark, sf_dir), TOPICS), TOPICS[0])
    asked = parse.usable(parse.parse_feed(mine, MAIL)).groupBy("mail_id").agg(F.count("*").alias("pulls"))
    found = enrich.lookup(asked, source(spark, sf_dir), MAIL)
    return found.select("mail_id", "pulls", F.col("record.title").alias("title"), "lookup_error")


def ready_with_gold(spark, sf_dir):
    """Each event's mail looked up in gold by its reader, with misses kept."""
    told = table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").cast("string").alias("mail_id"), F.lit("ready").alias("status")
    )
    rows = serving.notices_with_rows(told, _gold(spark, sf_dir), MAIL)
    return rows.select("event_id", "mail_id", "status", "title", "error")


def ready_as_of(spark, sf_dir):
    """Views as notices, each with the mail's row of its day, although the mail changed before and after.

    A purchase stores a row with the highest number of the day, errors alone remove it.
    """
    events = table(spark, sf_dir, "events").select(
        "event_id", "event_type", F.col("user_id").cast("string").alias("mail_id"),
        F.datediff(moment(), F.lit(EPOCH_ZERO)).cast("bigint").alias("epoch_id"), number_in_props().cast("bigint").alias("k"),
    )
    bought = F.col("event_type") == "purchase"
    log = events.where(F.col("event_type").isin("purchase", "error")).groupBy("mail_id", "epoch_id").agg(
        F.max(F.when(bought, F.col("k"))).alias("event_version"), F.when(F.bool_or(bought), "U").otherwise("D").alias("op")
    )
    told = events.where(F.col("event_type") == "view").select("event_id", "mail_id", "epoch_id")
    return serving.notices_as_of(told, log, MAIL)


def _receipts(spark, sf_dir):
    """Events read as receipts: the type is the consumer, the value a delay in hundredths."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").cast("string").alias("mail_id"),
        F.col("event_type").alias("consumer"),
        F.when(F.col("event_type") != "error", F.col("value") / 100).alias("delay"),
        moment().alias("received_at"),
    )


def consumer_receipts(spark, sf_dir):
    return activity.receipt_summary(_receipts(spark, sf_dir), "mail_id")


def slow_receipts(spark, sf_dir):
    return activity.receipt_rows(_receipts(spark, sf_dir)).select("event_id", "mail_id", "consumer", "is_slow")


def received_counts(spark, sf_dir):
    return activity.received_counts(_receipts(spark, sf_dir))


def last_n_per_consumer(spark, sf_dir):
    rows = _receipts(spark, sf_dir).select("consumer", "event_id", "mail_id", "received_at")
    order = [F.desc("received_at"), F.desc("event_id")]
    return activity.last_n(rows, ["consumer"], order, 50).select("consumer", "event_id", "mail_id", "position")


def latest_mail_groups(spark, sf_dir):
    rows = activity.latest_groups(_receipts(spark, sf_dir), "mail_id", "received_at")
    return rows.select("mail_id", micros_text(F.col("first_seen")).alias("first_seen"), "receipts")


def peak_concurrency(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        "event_type",
        moment().alias("started"),
        F.timestamp_micros(F.unix_micros(moment()) + F.round(F.col("value") * 1_000_000).cast("bigint")).alias("ended"),
    )
    return activity.concurrency(rows, ["event_type"], "started", "ended")


def kpi_summary(spark, sf_dir):
    """Health of nations as services: a signal per customer; an agency that no customer names is down."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    agencies = nations.select(F.concat("n_name", F.lit(" agency")).alias("service"))
    services = nations.select(F.col("n_name").alias("service")).union(agencies)
    signals = table(spark, sf_dir, "customer").join(nations, "c_nationkey").select(F.col("n_name").alias("service"))
    return activity.service_health(services, signals)


def log_union(spark, sf_dir):
    """The consumers' logs in one frame, counted per consumer and day."""
    rows = _receipts(spark, sf_dir)
    logs = activity.union_logs(
        [rows.where(F.col("consumer") == c).select("consumer", "mail_id", "received_at") for c in CONSUMERS]
    )
    return logs.groupBy("consumer", F.date_format("received_at", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("lines")
    )


def _access(spark, sf_dir):
    """Customers as key holders, segments as groups, nations as routes open to some segments."""
    people = table(spark, sf_dir, "customer")
    nations = table(spark, sf_dir, "nation")
    requests = people.select(
        F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("api_key"),
        F.col("c_nationkey").alias("route"),
        F.col("c_custkey").alias("request_id"),
    )
    credentials = people.select(F.col("c_name").alias("api_key"), F.col("c_custkey").alias("consumer"))
    memberships = people.select(F.col("c_custkey").alias("consumer"), F.col("c_mktsegment").alias("member_group"))
    routes = nations.select(
        F.col("n_nationkey").alias("route"),
        F.when(F.col("n_regionkey") == 0, "BUILDING")
        .when(F.col("n_regionkey") == 1, "MACHINERY")
        .otherwise("HOUSEHOLD")
        .alias("member_group"),
    )
    return requests, credentials, memberships, routes


def entitlement(spark, sf_dir):
    return serving.entitled(*_access(spark, sf_dir)).select("request_id", "route")


def entitlement_refused(spark, sf_dir):
    return serving.refused(*_access(spark, sf_dir)).select("request_id", "route")


def list_records(spark, sf_dir):
    rows = source(spark, sf_dir)
    return rows.select("lookup_id", F.col("record.title").alias("title"), F.md5(F.col("record.body").cast("binary")).alias("body_md5"))


QUERIES = {
    f.__name__: f
    for f in (
        parse_events, parse_moments, delete_ids, enrich_claim_check, validate_reasons, refine_pages, refine_docs, tagged_docs, mime_docs, deep_mime_docs,
        whitespace_docs, protect_roundtrip, stale_events, stale_events_in_runs, gold_state,
        lake_gold, lake_quarantine, upsert_merge, delete_apply, quarantine_union, ready_notices, accepted_rows, batch_metrics,
        epoch_counts, dlq_outcomes, redriven_events, parked_letters, serve_view, serve_lookup,
        fanout_topics, subscriber_records, ready_with_gold, ready_as_of, consumer_receipts, slow_receipts,
        received_counts, last_n_per_consumer, latest_mail_groups, peak_concurrency, kpi_summary,
        log_union, entitlement, entitlement_refused, list_records,
    )
}
QUERIES["latest_per_key"] = latest_event
