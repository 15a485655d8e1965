"""What follow-up scans must cover, and which cursors may advance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merged_scopes(requests: DataFrame, key: str) -> DataFrame:
    """requests (key, accounts array, null for all): the accounts that one follow-up pass must cover.

    Columns key, every and accounts (sorted; null where any request was for
    all).  An empty array asks for none.  Sets are united in each task before
    the shuffle, and nothing else of a key meets in one place.
    """
    one = requests.select(key, F.col("accounts").isNull().alias("_all"), F.explode_outer("accounts").alias("_account"))
    out = one.groupBy(key).agg(F.max("_all").alias("every"), F.collect_set(F.when(~F.col("_all"), F.col("_account"))).alias("_set"))
    return out.select(key, "every", F.when(~F.col("every"), F.sort_array("_set")).alias("accounts"))


def advanced_cursors(cursors: DataFrame, fetched: DataFrame, processed: DataFrame) -> DataFrame:
    """cursors (account_id, cursor), fetched (account_id, message_id, next_cursor), processed (account_id, message_id): the cursors after a scan.

    An account's cursor moves only if all that was fetched for it has been
    processed, and never backwards; else it stays and the next scan fetches
    again.  ``advanced`` tells which moved.  New accounts appear once they advance.
    """
    open_ = fetched.join(processed.select("account_id", "message_id"), ["account_id", "message_id"], "left_anti").select("account_id").distinct()
    after = fetched.groupBy("account_id").agg(F.max("next_cursor").alias("_next")).join(open_, "account_id", "left_anti")
    both = cursors.join(after, "account_id", "full_outer")
    moves = F.coalesce(F.col("_next") > F.col("cursor"), F.col("_next").isNotNull())
    return both.select("account_id", F.greatest("cursor", "_next").alias("cursor"), moves.alias("advanced"))
