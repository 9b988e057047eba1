"""Next-run times (P16, P17, P18), all in UTC and from a given ``now``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _two_am(now: Column) -> Column:
    return F.date_trunc("DAY", now) + F.make_dt_interval(F.lit(0), F.lit(2))


def _plus_days(ts: Column, days: Column) -> Column:
    return ts + F.make_dt_interval(days)


def next_run_daily(now) -> Column:
    """02:00 today if still strictly ahead, else 02:00 tomorrow."""
    n = _c(now)
    t = _two_am(n)
    return F.when(t <= n, _plus_days(t, F.lit(1))).otherwise(t)


def next_run_weekly(now) -> Column:
    """P17 (worker rule): 02:00 next Sunday; on Sunday today if still ahead, else +7."""
    n = _c(now)
    t = _two_am(n)
    days = (F.lit(8) - F.dayofweek(n)) % 7
    days = F.when((days == 0) & (t <= n), F.lit(7)).otherwise(days)
    return _plus_days(t, days)


def next_run_weekly_api(now) -> Column:
    """P17, dashboard rule: any time on Sunday goes to the next Sunday (+7)."""
    n = _c(now)
    t = _two_am(n)
    days = (F.lit(8) - F.dayofweek(n)) % 7
    return _plus_days(t, F.when(days == 0, F.lit(7)).otherwise(days))


def next_run(cron, now) -> Column:
    """Worker: next run for the two known crons, null for any other."""
    c = _c(cron)
    return (F.when(c == S.CRON_DAILY, next_run_daily(now))
            .when(c == S.CRON_WEEKLY, next_run_weekly(now)))


def schedule_to_cron(schedule, now) -> tuple[Column, Column]:
    """P18: 'daily'/'weekly' -> (cron, next run); anything else -> (null, null)."""
    s = _c(schedule)
    cron = (F.when(s == "daily", F.lit(S.CRON_DAILY)).when(s == "weekly", F.lit(S.CRON_WEEKLY)))
    nxt = (F.when(s == "daily", next_run_daily(now)).when(s == "weekly", next_run_weekly_api(now)))
    return cron, nxt
