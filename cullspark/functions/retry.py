"""What becomes of an attempt to upload a part, and how long the next one waits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import backoff_bound

# Attempts in all, the longest wait that a server may ask for in milliseconds, answers that are tried again.
ATTEMPTS, LONGEST = 4, 30_000
RETRIED = (408, 429, 500, 502, 503, 504)
#: Answers whose request to wait is followed.
ASKING = (429, 503)
#: What marks a bad request as one that came too slowly.
SLOW_REQUEST = r"<Code>\s*RequestTimeout\s*</Code>"


def retry_after(header: Column, now: Column) -> Column:
    """Milliseconds that a header asks to wait, from 0 to LONGEST: a number of seconds or a date (now in milliseconds); null where it says neither."""
    text = F.trim(header)
    seconds = text.try_cast("double")
    number = seconds.isNotNull() & ~F.isnan(seconds) & (F.abs(seconds) < float("inf"))
    date = F.regexp_extract(text, r"^[A-Za-z]{3}, (\d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) (GMT|UTC)$", 1)
    at = F.coalesce(F.unix_millis(F.try_to_timestamp(F.concat(F.nullif(date, F.lit("")), F.lit(" +0000")), F.lit("dd MMM yyyy HH:mm:ss Z"))), F.unix_millis(F.try_to_timestamp(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text))))
    wait = F.when(number, seconds * 1000).otherwise((at - now).cast("double"))
    return F.greatest(F.lit(0.0), F.least(F.lit(float(LONGEST)), wait)) + F.when(wait.isNull(), F.lit(None).cast("double")).otherwise(0.0)


def outcome(status: Column, etag: Column, body: Column, timed_out: Column) -> Column:
    """done, again and category of an attempt; a null status is an attempt without an answer."""
    fine = status.between(200, 299)
    done = fine & (F.coalesce(F.replace(etag, F.lit('"'), F.lit("")), F.lit("")) != "")
    slow = (status == 400) & F.coalesce(body.rlike(SLOW_REQUEST), F.lit(False))
    again = status.isNull() | (fine & ~done) | status.isin(*RETRIED) | slow
    category = F.when(status.isNotNull(), "http").when(F.coalesce(timed_out, F.lit(False)), "timeout").otherwise("network")
    return F.struct(F.coalesce(done, F.lit(False)).alias("done"), again.alias("again"), F.when(~F.coalesce(done, F.lit(False)), category).alias("category"))


def longest_wait(attempt: Column, status: Column, header: Column, now: Column) -> Column:
    """The longest that is waited after an attempt (from 0) that is tried again, in milliseconds: chance picks a share of the doubling part; null after the last."""
    asked = F.when(status.isin(*ASKING), retry_after(header, now))
    return F.when(attempt < ATTEMPTS - 1, F.greatest(backoff_bound(attempt).cast("double"), F.coalesce(asked, F.lit(0.0))))
