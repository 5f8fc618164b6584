"""Changes to the operational tables, each as a new version of the table."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.fixed_values import HISTORY_MESSAGES, RETENTION_DAYS
from ledgerloom.functions.dates import as_moment, day_shift
from ledgerloom.plans.joins import SALTS, lookup_join, pinned, top_per_group


def upsert(
    target: DataFrame, incoming: DataFrame, key: str, updated: list[str], as_of, order: str = "seq"
) -> DataFrame:
    """Insert rows with a new key; for known keys replace only the `updated` columns and stamp updated_at.

    Of several incoming rows with one key the last by `order` wins.
    """
    columns = [c for c in target.columns if c in incoming.columns and c != key]
    newest = incoming.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_new"))
    now = as_moment(as_of)

    def merged(column: str) -> Column:
        old, new = F.col(f"_old.{column}"), F.col(f"_new.{column}") if column in columns else F.lit(None)
        if column in ("created_at", "updated_at") and column not in columns:
            touched = F.col("_new").isNotNull() if column == "updated_at" else F.col("_old").isNull()
            return F.when(touched, now).otherwise(old)
        if column in updated:
            return F.when(F.col("_new").isNotNull(), new).otherwise(old)
        return F.when(F.col("_old").isNull(), new).otherwise(old)

    old = target.select(key, F.struct(*[c for c in target.columns if c != key]).alias("_old"))
    joined = old.join(newest, key, "full_outer")
    return joined.select(*[F.col(c) if c == key else merged(c).alias(c) for c in target.columns])


def insert_absent(target: DataFrame, incoming: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """Add rows whose key is not there yet; of several incoming rows with one key the first by `order` counts."""
    columns = [c for c in target.columns if c != key]
    first = incoming.groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("_new")).select(key, "_new.*")
    return target.unionByName(first.join(target.select(key), key, "left_anti").select(*target.columns))


def update_rows(table: DataFrame, condition: Column, changes: dict[str, Column], as_of) -> DataFrame:
    """Set columns on the rows that match and stamp updated_at."""
    changes = changes | {"updated_at": as_moment(as_of)}
    return table.withColumns({c: F.when(condition, new).otherwise(F.col(c)) for c, new in changes.items()})


def deactivate_clients(clients: DataFrame, condition: Column, as_of) -> DataFrame:
    return update_rows(clients, condition, {"active": F.lit(False)}, as_of)


def cascade_delete(tables: dict[str, DataFrame], deleted_users: DataFrame) -> dict[str, DataFrame]:
    """All tables without the deleted users and everything that belongs to them.

    Clients, uploads, analyses and reports go with their owner or parent; messages stay without a user, and uploads of
    other users stay without a deleted client. An owner may have any share of a table's rows; an upload and an analysis have few.
    """
    gone = pinned(deleted_users.select("user_id").distinct())

    def without(table: DataFrame, keys: DataFrame, column: str, salts: int = SALTS) -> DataFrame:
        return lookup_join(table, keys.select(F.col(keys.columns[0]).alias(column)), [column], "left_anti", salts=salts)

    def unlinked(table: DataFrame, keys: DataFrame, column: str) -> DataFrame:
        marked = lookup_join(table, keys.withColumn("_gone", F.lit(True)), [column], "left")
        return marked.withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).select(*table.columns)

    clients = tables["clients"]
    gone_owners = gone.withColumnRenamed("user_id", "owner_id")
    gone_clients = lookup_join(clients, gone_owners, ["owner_id"], "left_semi").select("client_id")
    uploads = without(tables["uploads"], gone, "user_id")
    gone_uploads = lookup_join(tables["uploads"], gone, ["user_id"], "left_semi").select("upload_id")
    analyses = without(without(tables["analyses"], gone, "user_id"), gone_uploads, "upload_id", 1)
    gone_analyses = tables["analyses"].join(analyses.select("analysis_id"), "analysis_id", "left_anti").select(
        "analysis_id"
    )
    return {
        "users": without(tables["users"], gone, "user_id"),
        "clients": without(clients, gone, "owner_id"),
        "uploads": unlinked(uploads, gone_clients, "client_id"),
        "analyses": analyses,
        "reports": without(without(tables["reports"], gone, "user_id"), gone_analyses, "analysis_id", 1),
        "messages": unlinked(tables["messages"], gone, "user_id"),
    }


def retained(uploads: DataFrame, as_of, days: int = RETENTION_DAYS) -> DataFrame:
    """Uploads that have not reached their delete_after time, which is shown."""
    return uploads.withColumn("delete_after", day_shift(F.col("created_at"), F.lit(days))).filter(
        F.col("delete_after") > as_moment(as_of)
    )


def with_access(rows: DataFrame, waitlist: DataFrame, phone: str = "phone") -> DataFrame:
    """Rows with `whitelisted`: whether the phone is on the list and approved."""
    approved = waitlist.filter("approved").select(F.col("phone").alias(phone)).distinct().withColumn(
        "_approved", F.lit(True)
    )
    return lookup_join(rows, approved, [phone], "left").withColumn(
        "whitelisted", F.coalesce("_approved", F.lit(False))
    ).drop("_approved")


def recipients(users: DataFrame, preference: str) -> DataFrame:
    """Users who opted in, have a phone, and asked for this kind of report (all opted-in ones if unknown)."""
    reachable = users.filter(F.col("whatsapp_opted_in") & (F.coalesce("phone", F.lit("")) != ""))
    return reachable.filter(F.col(preference)) if preference in users.columns else reachable


def message_history(contacts: DataFrame, messages: DataFrame, n: int = HISTORY_MESSAGES) -> DataFrame:
    """The newest `n` messages of each contact, by user or by phone, as an array from oldest to newest.

    Each of the two matches is cut to its newest `n` before they are merged, so a busy contact moves few rows.
    """
    newest = [F.desc("created_at"), F.desc("message_id")]
    columns = ["contact_id", "message_id", "direction", "message_text", "created_at"]
    spoken = messages.filter(F.col("direction").isin("inbound", "outbound"))

    def matched(contact_key: str, message_key: str) -> DataFrame:
        keys = contacts.filter(F.col(contact_key).isNotNull()).select(
            "contact_id", F.col(contact_key).alias(message_key)
        )
        hits = lookup_join(spoken, keys, [message_key], spread_by=["message_id"]).select(*columns)
        return top_per_group(hits, ["contact_id"], newest, n).drop("rank")

    both = matched("user_id", "user_id").unionByName(matched("phone", "phone_number"))
    last = top_per_group(both.dropDuplicates(["contact_id", "message_id"]), ["contact_id"], newest, n)
    role = F.when(F.col("direction") == "inbound", "user").otherwise("assistant")
    turn = F.struct(
        "created_at", "message_id", role.alias("role"), F.coalesce("message_text", F.lit("")).alias("text")
    )
    return last.groupBy("contact_id").agg(
        F.transform(
            F.array_sort(F.collect_list(turn)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))
        ).alias("history")
    )
