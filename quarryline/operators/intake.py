"""What may come in: chat requests, metadata, repositories, jobs, and rows that belong to a split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .selection import ranked, require_empty

# Forms of metadata that may be shown, of repository names, and of software-only repositories.
PLAIN, HEX = r"^[A-Za-z0-9_.+ @:-]{1,128}\z", r"^[0-9a-f]{64}\z"
DETAILS = {"served_model_name": PLAIN, "backend": PLAIN, "backend_version": PLAIN, "base_model_name": PLAIN,
           "model_fingerprint": HEX, "adapter_sha256": HEX, "base_model_sha256": HEX}
REPOSITORY = r"^[A-Za-z0-9_-]+/[A-Za-z0-9_.-]+\z"
SOFTWARE = r"(?i)(arduino|library|_py$|python|circuitpython|micropython|firmware|_lib)"
#: Fixed value: blocks that a message holds at most.
BLOCKS = 32


def as_blocks(message: Column) -> Column:
    """The blocks of a message (role, content, blocks): a string is one block of text."""
    own = F.struct(F.lit("text").alias("type"), message["content"].alias("text"), F.lit(None).cast("string").alias("image"))
    return F.when(message["content"].isNotNull(), F.array(own)).otherwise(message["blocks"])


def _sound(block: Column, role: Column) -> Column:
    text = (block["type"] == "text") & block["text"].rlike(r"(?U)\S") & block["image"].isNull()
    image = (block["type"] == "image") & (role == "user") & block["image"].rlike(r"(?U)\S") & block["text"].isNull()
    return F.coalesce(text, F.lit(False)) | F.coalesce(image, F.lit(False))


def block_text(role: Column, blocks: Column) -> Column:
    """The texts of a message's blocks, a line break between; null if a block is malformed or none is text."""
    texts = F.filter(blocks, lambda b: b["type"] == "text")
    sound = F.forall(blocks, lambda b: _sound(b, role)) & (F.size(texts) > 0)
    return F.when(sound, F.array_join(F.transform(texts, lambda b: b["text"]), "\n"))


def requests(chats: DataFrame, most_messages: int = 64, most_images: int = 4, most_chars: int = 200_000) -> DataFrame:
    """chats (messages: role, content, blocks of type, text, image) with normal, the messages as role
    and blocks, and fault, the first rule that they break: messages (none or too many), roles (user
    and assistant take turns behind an optional system message), blocks, text or images (too much of
    them), end (not with the user). normal is null where there is a fault."""
    made = chats.withColumn("normal", F.transform("messages", lambda m: F.struct(m["role"].alias("role"), as_blocks(m).alias("blocks"))))
    m = F.col("normal")
    lead = F.when(F.get(m, 0)["role"] == "system", 1).otherwise(0)
    turns = F.slice(m, lead + 1, F.size(m))
    wrong = F.exists(F.transform(turns, lambda x, i: ~x["role"].eqNullSafe(F.when(i % 2 == 0, "user").otherwise("assistant"))), lambda bad: bad)
    bad = F.exists(m, lambda x: ~F.coalesce(F.size(x["blocks"]).between(1, BLOCKS) & F.forall(x["blocks"], lambda b: _sound(b, x["role"])), F.lit(False)))
    blocks = F.flatten(F.transform(m, lambda x: x["blocks"]))
    chars = F.aggregate(blocks, F.lit(0).cast("long"), lambda n, b: n + F.coalesce(F.length(b["text"]), F.lit(0)))
    fault = F.when(~F.coalesce(F.size(m).between(1, most_messages), F.lit(False)), "messages").when(wrong, "roles").when(bad, "blocks").when(
        chars > most_chars, "text").when(F.size(F.filter(blocks, lambda b: b["type"] == "image")) > most_images, "images").when(
        F.element_at(m, -1)["role"] != "user", "end")
    return made.withColumn("fault", fault).withColumn("normal", F.when(F.col("fault").isNull(), m))


def safe_details(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the metadata that may be shown; a value of another form is null, all other columns go."""
    return df.select(*keys, *(F.when(F.col(c).rlike(form), F.col(c)).alias(c) for c, form in DETAILS.items() if c in df.columns))


def collectable(repositories: DataFrame, publishers: list[str], licences: list[str], hardware_only: list[str]) -> DataFrame:
    """The repositories (repository, licence) of allowed publishers and licences that are not named as
    software; publishers in hardware_only are not asked for that."""
    owner, name = F.substring_index("repository", "/", 1), F.substring_index("repository", "/", -1)
    return repositories.where(F.col("repository").rlike(REPOSITORY) & owner.isin(publishers) & F.col("licence").isin(licences)
                              & (owner.isin(hardware_only) | ~name.rlike(SOFTWARE)))


def runnable(jobs: DataFrame, adapters: DataFrame, publish: bool, free_mb: int, reserve_mb: int) -> DataFrame:
    """jobs (adapter, kind) with reason, why one can't run now, or null: its adapter (name, kind, ready,
    gpu_mb) is missing, of another kind or not ready; it is a proposal and publication is off; or its
    memory and the reserve exceed what is free."""
    own = adapters.select(F.col("name").alias("adapter"), F.struct("kind", "ready", "gpu_mb").alias("_a"))
    fit = (F.col("_a.kind") == F.col("kind")) & F.col("_a.ready")
    memory = F.coalesce("_a.gpu_mb", F.lit(0))
    reason = F.when(~F.coalesce(fit, F.lit(False)), "adapter not ready").when((F.col("kind") == "proposal") & F.lit(not publish), "publication disabled").when(
        (memory > 0) & (memory + reserve_mb > free_mb), "no memory")
    return jobs.join(own, "adapter", "left").withColumn("reason", reason).drop("_a")


def owned(records: DataFrame, families: DataFrame, family: str, splits: list[str]) -> DataFrame:
    """records with the split that families (family, split) gives theirs, if it is one of splits; the
    others go. A family in two splits is an error."""
    require_empty(families.groupBy(family).agg(F.countDistinct("split").alias("n")).where("n > 1"), "families stand in several splits")
    return records.join(families.where(F.col("split").isin(splits)).select(family, "split").distinct(), family)


def with_view(rows: DataFrame, views: DataFrame, keys: list[str], field: str) -> DataFrame:
    """rows with field of their only view by keys, null where they have none; two views for a key are
    an error."""
    one = views.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(field).alias(field))
    require_empty(one.where("_n > 1").select(*keys), "several views for a key")
    return rows.join(one.drop("_n"), keys, "left")


def in_catalog_order(entries: DataFrame, publishers: list[str]) -> DataFrame:
    """entries (publisher, title, id) with rank from 0: by the place of their publisher in the list, then title, then id.
    Unlisted publishers come last."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, publishers)), F.col("publisher")), F.lit(0).cast("long")), F.lit(len(publishers) + 1).cast("long"))
    return ranked(entries, [place, F.col("title"), F.col("id")])
