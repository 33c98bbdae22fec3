"""Comparison SQL for hashed draws: SplitMix64 with 64-bit products put together from 32-bit halves."""

from __future__ import annotations

from towline.operators.resampling import GOLDEN, LEAF, MIX_1, MIX_2, NODES

_LOW = 4294967295
_WORD = 4294967296


def _product(source: str, keep: str, factor: int) -> str:
    """Column ``z`` of ``source`` times a constant, modulo 2^64."""
    low, high = factor & _LOW, factor >> 32
    halves = f"SELECT {keep}, z & {_LOW}::UBIGINT AS a, z >> 32 AS b FROM ({source})"
    parts = (
        f"SELECT {keep}, a * {low}::UBIGINT AS p, "
        f"((b * {low}::UBIGINT) & {_LOW}::UBIGINT) + ((a * {high}::UBIGINT) & {_LOW}::UBIGINT) AS q FROM ({halves})"
    )
    return f"SELECT {keep}, (((p >> 32) + q) & {_LOW}::UBIGINT) * {_WORD}::UBIGINT + (p & {_LOW}::UBIGINT) AS z FROM ({parts})"


def mixed(source: str, keep: str) -> str:
    """Output function applied to column ``z`` (UBIGINT) of ``source``; other columns in ``keep`` stay."""
    one = _product(f"SELECT {keep}, xor(z, z >> 30) AS z FROM ({source})", keep, MIX_1)
    two = _product(f"SELECT {keep}, xor(z, z >> 27) AS z FROM ({one})", keep, MIX_2)
    return f"SELECT {keep}, xor(z, z >> 31) AS z FROM ({two})"


def counter(source: str, keep: str, number: str) -> str:
    """``number`` (a whole-number expression over ``source``) times the generator's increment."""
    return _product(f"SELECT {keep}, ({number})::UBIGINT AS z FROM ({source})", keep, GOLDEN)


def _product_list(values: str, factor: int) -> str:
    """Each entry of a list of UBIGINT times a constant, modulo 2^64."""
    low, high = factor & _LOW, factor >> 32
    ours, upper = f"((z & {_LOW}::UBIGINT) * {low}::UBIGINT)", f"(((z >> 32) * {low}::UBIGINT) & {_LOW}::UBIGINT)"
    carry = f"((({ours} >> 32) + {upper} + (((z & {_LOW}::UBIGINT) * {high}::UBIGINT) & {_LOW}::UBIGINT)) & {_LOW}::UBIGINT)"
    return f"list_transform({values}, lambda z: {carry} * {_WORD}::UBIGINT + ({ours} & {_LOW}::UBIGINT))"


def _hash_list(counters: str, base: str) -> str:
    """The counter hash of stream ``base`` at a list of places."""
    z = f"list_transform({_product_list(counters, GOLDEN)}, lambda z: xor(z, {base}))"
    z = f"list_transform({z}, lambda z: xor(z, z >> 30))"
    z = f"list_transform({_product_list(z, MIX_1)}, lambda z: xor(z, z >> 27))"
    return f"list_transform({_product_list(z, MIX_2)}, lambda z: xor(z, z >> 31))"


# Of the c draws of a node how many go left: ones among c bits of the node's stream.
_WORDS = "list_transform(range(1, (c + 63) // 64 + 1), lambda w: (r * ((m + 63) // 64) + w)::UBIGINT)"
_MASK = "(18446744073709551615::UBIGINT >> (64 - least(64, c - 64 * (w - 1)))::UBIGINT)"
_LEFT = f"coalesce(list_sum(list_transform({_hash_list(_WORDS, 'stream')}, lambda z, w: bit_count((z & {_MASK})::HUGEINT))), 0)::BIGINT"


def draws(strata: str, keep: str, reps: int) -> str:
    """Draws of every stratum and replicate.

    ``strata`` has the columns ``keep``, ``base`` (hash of the stratum), ``m`` (draws) and ``n``
    (rows). Gives ``keep``, ``r`` and ``i``, the row position drawn. Draws are dealt down a tree that halves the stratum to
    leaves of LEAF rows at most; ``o`` are those of a replicate to the left of a node.
    """
    cols = f"{keep}, base, m, n, depth, r"
    deep = f"CASE WHEN n <= {LEAF} THEN 0 ELSE ceil(log2(ceil(n / {LEAF}::DOUBLE)))::INTEGER END"
    stream = _hash_list(f"[({NODES} + (1::BIGINT << level) + j)::UBIGINT]", "base::UBIGINT") + "[1]"
    tree = f"""WITH RECURSIVE tree AS (
        SELECT {keep}, base, m::BIGINT AS m, n::BIGINT AS n, {deep} AS depth, r, 0 AS level, 0::BIGINT AS j, m::BIGINT AS c, 0::BIGINT AS o
        FROM ({strata}), range({reps}) a(r) WHERE m > 0
        UNION ALL
        SELECT {cols}, level + 1, 2 * j + side, CASE WHEN side = 0 THEN ahead ELSE c - ahead END, o + side * ahead
        FROM (SELECT *, {_LEFT} AS ahead FROM (SELECT *, {stream} AS stream FROM tree WHERE level < depth AND c > 0)), (VALUES (0), (1)) s(side))
      SELECT * FROM tree WHERE level = depth AND c > 0"""
    grid = f"SELECT {cols}, j, o, k FROM ({tree}), LATERAL (SELECT unnest(range(c)) AS k)"
    z = counter(grid, f"{cols}, j", "r * m + o + k + 1")
    z = f"SELECT {cols}, j, xor(z, base::UBIGINT) AS z FROM ({z})"
    drawn = f"SELECT {cols}, j, (z >> 32)::HUGEINT AS v, 1::HUGEINT << depth AS leaves FROM ({mixed(z, f'{cols}, j')})"
    return f"SELECT {keep}, m, n, r, (((j * 4294967296::HUGEINT + v) * n) // (leaves * 4294967296::HUGEINT))::BIGINT AS i FROM ({drawn})"


def base_hash(seed: int, *keys: str) -> str:
    text = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"CAST('0x' || substr(md5(concat_ws('|', '{seed}', {text})), 1, 15) AS BIGINT)"
