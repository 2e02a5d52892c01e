"""Traffic-side analytics: token estimates, counters, and state machines per key.

The machines are sequential by nature: each runs over one key's events in order, in
`applyInPandas`. A cache has one eviction order over all tenants, so its key is the
cache itself; partition requests by cache to scale it out.
"""

from __future__ import annotations

from collections import OrderedDict
from math import ceil

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bytes_of(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit("")))


def prompt_tokens(contents: Column) -> Column:
    """A quarter of each message's bytes, rounded down, and four."""
    return F.aggregate(contents, F.lit(0).cast("long"), lambda n, c: n + F.floor(bytes_of(c) / 4) + 4)


def estimated_tokens(contents: Column, max_tokens: Column) -> Column:
    return prompt_tokens(contents) + F.when(max_tokens > 0, max_tokens).otherwise(256)


def actual_tokens(usage_total: Column, contents: Column, answer: Column) -> Column:
    return F.coalesce(usage_total.cast("long"), prompt_tokens(contents) + F.floor(bytes_of(answer) / 4))


def saved_tokens(usage_total: Column, answer: Column) -> Column:
    """What a cached answer saves: its reported usage, else the metered answer."""
    return F.coalesce(usage_total.cast("long"), F.floor(bytes_of(answer) / 4))


def cacheable(temperature: Column) -> Column:
    """Only requests that ask for temperature 0 in so many words."""
    return F.coalesce(temperature == 0, F.lit(False))


def finish_reason(reason: Column) -> Column:
    return F.when(reason == "length", "length").otherwise("stop")


def usage_total(lines: Column) -> Column:
    """Prompt and answer tokens that a stream's closing line reports; null for a truncated stream.

    `lines`: array of structs with done, prompt_eval_count and eval_count.
    """
    last = F.filter(lines, lambda x: F.coalesce(x["done"], F.lit(False)))
    return F.when(F.size(last) > 0, F.coalesce(last[0]["prompt_eval_count"], F.lit(0)) + F.coalesce(last[0]["eval_count"], F.lit(0))).cast("long")


def counter_key(name: Column, labels: Column) -> Column:
    """Identity of a counter: its name and, by label, NUL, label, = and value."""
    pairs = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(F.lit("\0"), e["key"], F.lit("="), e["value"]))
    return F.concat(name, F.array_join(pairs, ""))


def nice_ceil(x: Column) -> Column:
    """The next 1, 2 or 5 times a power of ten from `x` on; 1 where it is not positive."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(x)))
    step = F.when(x <= power, power).when(x <= 2 * power, 2 * power).when(x <= 5 * power, 5 * power).otherwise(10 * power)
    return F.when(x > 0, step).otherwise(F.lit(1.0))


def parse_tenants(spec: str) -> list[tuple[str, str, int]]:
    """(name, key, tokens a minute) of `name:key:tpm,...`; none for a blank specification."""
    found: list[tuple[str, str, int]] = []
    for entry in spec.split(",") if spec.strip() else []:
        fields = [f.strip() for f in entry.strip().split(":")]
        if len(fields) != 3 or not fields[0] or not fields[1]:
            raise ValueError(f"a tenant is name:key:tokens-per-minute, not {entry!r}")
        if not fields[2].removeprefix("+").isdecimal() or int(fields[2]) <= 0:
            raise ValueError(f"tokens per minute must be a positive integer in {entry!r}")
        if any(key == fields[1] for _, key, _ in found):
            raise ValueError(f"the key of {entry!r} is another tenant's")
        found.append((fields[0], fields[1], int(fields[2])))
    return found


def cost_usd(tokens: Column, price_per_million: float) -> Column:
    return tokens * F.lit(price_per_million) / F.lit(1e6)


def _field(text: Column) -> Column:
    raw = F.encode(text, "UTF-8")
    return F.concat(F.unhex(F.lpad(F.hex(F.length(raw)), 8, "0")), raw)


def cache_key(tenant: Column, model: Column, max_tokens: Column, messages: Column) -> Column:
    """SHA-256 over length-prefixed fields of a cacheable request (temperature 0)."""
    cap = F.coalesce(max_tokens.cast("string"), F.lit("\0default"))
    head = F.concat(_field(tenant), _field(model), _field(F.lit("0")), _field(cap))
    body = F.aggregate(messages, head, lambda a, m: F.concat(a, _field(m["role"]), _field(m["content"])))
    return F.sha2(body, 256)


def cumulative(events: DataFrame, by: list[str], value: str, order: str, process: str) -> DataFrame:
    """Running totals of each series since its process started."""
    w = Window.partitionBy(process, *by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("total", F.sum(value).over(w))


class Budget:
    """A token bucket: `reserve` an estimate, `settle` it with what was used. Times in ms."""

    def __init__(self, per_minute: int, now: int = 0):
        self.capacity = float(per_minute)
        self.rate = per_minute / 60
        self.available, self.at = self.capacity, now

    def refill(self, now: int) -> None:
        if now > self.at:
            self.available = min(self.capacity, self.available + (now - self.at) / 1000 * self.rate)
            self.at = now

    def reserve(self, want: float, now: int) -> tuple[str, int]:
        """admitted, over_capacity (never fits) or exhausted with the seconds to wait."""
        self.refill(now)
        if want > self.capacity:
            return "over_capacity", 0
        if want > self.available:
            return "exhausted", max(1, ceil((want - self.available) / self.rate))
        self.available -= want
        return "admitted", 0

    def settle(self, reserved: float, used: float, now: int) -> None:
        self.refill(now)
        self.available = min(self.capacity, self.available + reserved - used)


class Cache:
    """Least recently used entries with a time to live. Times in ms."""

    def __init__(self, size: int = 1024, ttl_ms: int = 300_000):
        self.size, self.ttl = size, ttl_ms
        self.entries: OrderedDict[str, tuple[int, int]] = OrderedDict()

    def get(self, key: str, now: int) -> int | None:
        """Tokens that a hit saves; None for a miss."""
        found = self.entries.get(key)
        if not found:
            return None
        if now > found[0]:
            del self.entries[key]
            return None
        self.entries.move_to_end(key)
        return found[1]

    def put(self, key: str, tokens: int, now: int) -> None:
        self.entries.pop(key, None)
        while len(self.entries) >= self.size:
            self.entries.popitem(last=False)
        self.entries[key] = (now + self.ttl, tokens)


class Breaker:
    """closed, open after `threshold` failures in a row, half-open with one trial after `cooldown_ms`."""

    def __init__(self, threshold: int = 3, cooldown_ms: int = 10_000):
        self.threshold, self.cooldown = threshold, cooldown_ms
        self.state, self.failures, self.since = "closed", 0, 0

    def allow(self, now: int) -> bool:
        if self.state == "closed":
            return True
        if now - self.since < self.cooldown:
            return False
        # Cooled down, or a trial that never reported: one request may try.
        self.state, self.since = "half_open", now
        return True

    def report(self, ok: bool, now: int) -> None:
        if self.state == "open":
            return
        if ok:
            self.state, self.failures = "closed", 0
            return
        self.failures += 1
        if self.state == "half_open" or self.failures >= self.threshold:
            self.state, self.since, self.failures = "open", now, 0


def run_budget(requests: DataFrame, per_minute: int) -> DataFrame:
    """Requests (tenant, t, arrival, estimate, used) with outcome, retry_after and what is left after each."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["t", "arrival"])
        b, out = None, []
        for t, want, used in zip(rows["t"], rows["estimate"], rows["used"], strict=True):
            b = b or Budget(per_minute, t)
            outcome, wait = b.reserve(want, t)
            if outcome == "admitted":
                b.settle(want, used, t)
            out.append((outcome, wait, b.available))
        return rows[["tenant", "t", "arrival"]].assign(outcome=[o[0] for o in out], retry_after=[o[1] for o in out], available=[o[2] for o in out])

    kind = requests.schema["tenant"].dataType.simpleString()
    return requests.groupBy("tenant").applyInPandas(one, f"tenant {kind}, t bigint, arrival bigint, outcome string, retry_after bigint, available double")


def tenant_status(outcomes: DataFrame, charged: DataFrame, per_minute: int) -> DataFrame:
    """Per tenant: what is left, capacity, admitted, rejected and charged tokens, by name."""
    last = outcomes.groupBy("tenant").agg(
        F.floor(F.max_by("available", F.struct("t", "arrival"))).alias("available"), F.lit(per_minute).alias("capacity"),
        F.count_if(F.col("outcome") == "admitted").alias("admitted"), F.count_if(F.col("outcome") != "admitted").alias("rejected"),
    )
    return last.join(charged, "tenant", "left").orderBy("tenant")


def run_cache(requests: DataFrame, size: int = 1024, ttl_ms: int = 300_000) -> DataFrame:
    """Requests (cache, key, t, arrival, tokens) with `cached` (hit or miss) and `saved` tokens."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["t", "arrival"])
        cache, out = Cache(size, ttl_ms), []
        for key, t, tokens in zip(rows["key"], rows["t"], rows["tokens"], strict=True):
            got = cache.get(key, t)
            if got is None:
                cache.put(key, tokens, t)
            out.append(("miss", 0) if got is None else ("hit", got))
        return rows[["cache", "key", "t", "arrival"]].assign(cached=[o[0] for o in out], saved=[o[1] for o in out])

    return requests.groupBy("cache").applyInPandas(one, "cache string, key string, t bigint, arrival bigint, cached string, saved bigint")


def run_breaker(calls: DataFrame, threshold: int = 3, cooldown_ms: int = 10_000) -> DataFrame:
    """Calls (provider, t, arrival, ok) with `allowed` and the state after each."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["t", "arrival"])
        b, out = Breaker(threshold, cooldown_ms), []
        for t, ok in zip(rows["t"], rows["ok"], strict=True):
            allowed = b.allow(t)
            if allowed:
                b.report(bool(ok), t)
            out.append((allowed, b.state))
        return rows[["provider", "t", "arrival"]].assign(allowed=[o[0] for o in out], state=[o[1] for o in out])

    return calls.groupBy("provider").applyInPandas(one, "provider string, t bigint, arrival bigint, allowed boolean, state string")


def cache_counters(outcomes: DataFrame) -> DataFrame:
    """Of `run_cache`: hits, misses and tokens saved of each cache."""
    return outcomes.groupBy("cache").agg(F.count_if(F.col("cached") == "hit").alias("hits"), F.count_if(F.col("cached") == "miss").alias("misses"), F.sum("saved").alias("tokens_saved"))


def run_reservations(events: DataFrame, per_minute: int) -> DataFrame:
    """A budget with open reservations, over events (tenant, request, kind, t, arrival, tokens).

    A `reserve` asks for tokens; a `settle` later says how many were used, counts once,
    and only for an admitted request. Every event returns with outcome (that of the
    reservation; settled or ignored), retry_after and what is available after it.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["t", "arrival"])
        b, held, out = Budget(per_minute, int(rows["t"].iloc[0])), {}, []
        for request, kind, t, tokens in zip(rows["request"], rows["kind"], rows["t"], rows["tokens"], strict=True):
            wait = 0
            if kind == "reserve":
                outcome, wait = b.reserve(tokens, t)
                if outcome == "admitted":
                    held[request] = tokens
            elif request in held:
                b.settle(held.pop(request), tokens, t)
                outcome = "settled"
            else:
                outcome = "ignored"
            out.append((outcome, wait, b.available))
        return rows[["tenant", "request", "kind", "t", "arrival"]].assign(outcome=[o[0] for o in out], retry_after=[o[1] for o in out], available=[o[2] for o in out])

    return events.groupBy("tenant").applyInPandas(one, "tenant string, request bigint, kind string, t bigint, arrival bigint, outcome string, retry_after bigint, available double")


def run_router(requests: DataFrame, providers: tuple[str, ...], threshold: int = 3, cooldown_ms: int = 10_000) -> DataFrame:
    """Failover over a chain of providers, whose breakers live requests and probes drive.

    Requests (pool, t, arrival, good, probe, cancelled): `good` maps a provider to
    whether it would answer. Each request tries the providers in order, those whose
    breaker lets it; a failure goes on to the next one, a cancelled request reports
    nothing. A row that names a `probe` only asks that provider, and only while its
    breaker is not closed: it is the trial then. Returns (pool, t, arrival, provider that
    answered or null, attempts, states). A pool has breakers of its own; it is one group.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["t", "arrival"])
        breakers, out = {p: Breaker(threshold, cooldown_ms) for p in providers}, []
        for t, good, probe, cancelled in zip(rows["t"], rows["good"], rows["probe"], rows["cancelled"], strict=True):
            good, served, attempts = dict(good), None, 0
            if probe is not None and probe == probe:
                b = breakers[probe]
                if b.state != "closed" and b.allow(t):
                    b.report(bool(good.get(probe)), t)
            else:
                for p in providers:
                    if not breakers[p].allow(t):
                        continue
                    attempts += 1
                    if cancelled:
                        break
                    breakers[p].report(bool(good.get(p)), t)
                    if good.get(p):
                        served = p
                        break
            out.append((served, attempts, ",".join(breakers[p].state for p in providers)))
        return rows[["pool", "t", "arrival"]].assign(provider=[o[0] for o in out], attempts=[o[1] for o in out], states=[o[2] for o in out])

    return requests.groupBy("pool").applyInPandas(one, "pool string, t bigint, arrival bigint, provider string, attempts bigint, states string")


def route(attempts: DataFrame) -> DataFrame:
    """The first allowed and successful provider of each request (request, place, provider, allowed, ok)."""
    good = attempts.filter("allowed and ok")
    return good.groupBy("request").agg(F.min_by("provider", "place").alias("provider"), F.min("place").alias("place"))
