"""Chat formatting after a collapse of cumulative snapshots.

Logs often hold a conversation again and again, each time a few turns longer.
Rolling hashes of turn prefixes tell which conversations are a proper prefix
of another; an anti-join keeps the maximal ones, one of each set of copies,
and their turns are rendered.

A prefix's hash is the XOR of hashes of its turns with their places, so that
the hash of a conversation of any length adds up from parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.running import deal, totals
from plumbline.session import cut, table

ORDER = ["turn", "role", "digest"]
PREFIX = ["pos", "x1", "x2"]
#: What a role may not hold, so that no role can end its own mark.
ODD = "[^a-z0-9_-]+"


def _turns(chats: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, digest): null and empty roles are ``user``, null texts empty."""
    role = F.regexp_replace(F.lower(F.trim("role")), ODD, "_")
    role = F.when(F.length(role) > 0, role).otherwise(F.lit("user"))
    return chats.select("conv_id", "turn", role.alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")).where("conv_id is not null").withColumn("digest", F.md5("text"))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, pos, x1, x2): each distinct turn with its place from 1 and the hashes of the prefix that it ends."""
    dealt = deal(turns.select("conv_id", *ORDER).distinct(), ["conv_id"], ORDER)
    dealt = totals(dealt, ["conv_id"], ORDER, {"pos": (F.sum, lambda a, b: a + b, F.lit(1))})
    xor = lambda a, b: a.bitwiseXOR(b)
    return totals(dealt, ["conv_id"], ORDER, {"x1": (F.bit_xor, xor, F.xxhash64("pos", "role", "digest")), "x2": (F.bit_xor, xor, F.xxhash64("digest", F.lit(17), "role", "pos"))}).drop("__part")


def maximal(prefix: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of the conversations that are no proper prefix of another, and of equal ones the smallest id."""
    whole = prefix.groupBy("conv_id").agg(F.max(F.struct(*PREFIX)).alias("w")).select("conv_id", "w.*")
    own = whole.groupBy(*PREFIX).agg(F.min("conv_id").alias("conv_id"))
    longer = prefix.join(whole.select("conv_id", F.col("pos").alias("n_turns")), "conv_id").where("pos < n_turns").select(*PREFIX).distinct()
    return own.join(longer, PREFIX, "left_anti").select("conv_id", F.col("pos").alias("n_turns"))


def rendered(role: Column, text: Column, pos: Column, n_turns: Column) -> Column:
    """A turn between its marks. A conversation's turns in a row are its document.

    In a text every backslash is doubled and one is put between ``<`` and
    ``|``, so that no text holds a mark and each can be read back.
    """
    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    body = F.concat(F.lit("<|"), role, F.lit("|>\n"), plain, F.lit("<|end|>\n"))
    return F.concat(F.when(pos == 1, F.lit("<|begin|>\n")).otherwise(F.lit("")), body, F.when(pos == n_turns, F.lit("<|stop|>\n")).otherwise(F.lit("")))


def formatted(chats: DataFrame) -> DataFrame:
    """conv_id, pos, n_turns, role and rendered of each turn of the maximal conversations.

    One row a turn, so that a conversation of any length needs no task that
    holds it whole.

    * Turns go by turn number (null first), then role, then the MD5 of the text.
    * Turns that repeat number, role and text of one of their conversation
      count once; rows without conv_id are left out.
    * Roles are trimmed and in lower case; what isn't a letter a to z, digit, ``_`` or ``-`` is ``_``.
      Null and empty roles are ``user``, null and empty texts are empty turns.
    * An empty table gives no rows; other columns aren't read.
    """
    turns = _turns(chats)
    prefix = cut(prefixes(turns))
    kept = prefix.join(maximal(prefix), "conv_id").select(*[F.col(c).alias(f"__{c}") for c in ("conv_id", *ORDER)], "pos", "n_turns")
    on = turns["turn"].eqNullSafe(kept["__turn"])
    for c in ("conv_id", "role", "digest"):
        on = on & (turns[c] == kept[f"__{c}"])
    rows = turns.join(kept, on).dropDuplicates(["conv_id", *ORDER])
    return rows.select("conv_id", "pos", "n_turns", "role", rendered(F.col("role"), F.col("text"), F.col("pos"), F.col("n_turns")).alias("rendered"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5 over the whole table ``conversations``."""
    return formatted(table(spark, sf_dir, "conversations"))


ORACLE = r"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(nullif(regexp_replace(lower(trim(role)), '[^a-z0-9_-]+', '_', 'g'), ''), 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, list(concat(role, chr(1), text) ORDER BY turn NULLS FIRST, role, md5(text)) AS turns, count(*) AS n FROM t GROUP BY conv_id
), o AS (SELECT min(conv_id) AS conv_id, turns, n FROM c GROUP BY turns, n),
p AS (SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, n)) AS k FROM c)),
kept AS (SELECT conv_id, n FROM o WHERE turns NOT IN (SELECT turns FROM p)),
r AS (SELECT t.*, kept.n, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS pos FROM t JOIN kept USING (conv_id))
SELECT conv_id, pos, n AS n_turns, role,
  CASE WHEN pos = 1 THEN '<|begin|>' || chr(10) ELSE '' END || '<|' || role || '|>' || chr(10) || replace(replace(text, '\', '\\'), '<|', '<\|') || '<|end|>' || chr(10)
  || CASE WHEN pos = n THEN '<|stop|>' || chr(10) ELSE '' END AS rendered
FROM r
"""
