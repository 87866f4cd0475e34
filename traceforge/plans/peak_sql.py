"""DuckDB SQL of peak detection: local maxima, height, distance, prominence and width over lists of samples."""

from __future__ import annotations

KEY = "plate, well, channel"


def edges(rel: float) -> tuple[str, str]:
    """Interpolated ends at ``rel`` of the prominence below the top, from the columns of ``finder``."""
    level = f"(s - {rel} * prom)"
    i = f"coalesce(list_max(list_filter(range(lb, pos + 1), lambda i: sl[i + 1] <= {level})), lb)"
    k = f"coalesce(list_min(list_filter(range(pos, rb + 1), lambda i: sl[i + 1] <= {level})), rb)"
    left = f"CASE WHEN sl[{i} + 1] < {level} THEN {i} + ({level} - sl[{i} + 1]) / (sl[{i} + 2] - sl[{i} + 1]) ELSE {i} END"
    right = f"CASE WHEN sl[{k} + 1] < {level} THEN {k} - ({level} - sl[{k} + 1]) / (sl[{k}] - sl[{k} + 1]) ELSE {k} END"
    return left, right


def finder(source: str, name: str, height: str, distance: int, prominence: str, width: float) -> list[str]:
    """CTEs that end in ``name``: the peaks of ``source`` (plate, well, channel, pos from 0, s, and what ``height`` and ``prominence`` read), with prom, width, valleys lb and rb, and the samples sl.

    The greedy thinning by distance is a fold over each trace's candidates, from the tallest down, of equals the later first.
    """
    near = f"list_bool_or(list_transform(acc, lambda k: abs(k - x[1]) < {distance}))"
    left, right = edges(0.5)
    return [
        f"{name}_a AS (SELECT *, coalesce(lag(s) OVER w <> s, true) AS fresh FROM {source} WINDOW w AS (PARTITION BY {KEY} ORDER BY pos))",
        f"{name}_b AS (SELECT *, lag(s) OVER w AS b, lead(s) OVER w AS a, lead(pos) OVER w - 1 AS e FROM {name}_a WHERE fresh WINDOW w AS (PARTITION BY {KEY} ORDER BY pos))",
        f"{name}_c AS MATERIALIZED (SELECT {KEY}, CAST((pos + e) // 2 AS BIGINT) AS pos, s FROM {name}_b WHERE s > b AND s > a AND s >= {height})",
        f"{name}_d AS (SELECT {KEY}, unnest(list_reduce(ps, lambda acc, x: CASE WHEN {near} THEN acc ELSE acc || x END)) AS pos FROM (SELECT {KEY}, list([pos] ORDER BY s DESC, pos DESC) AS ps FROM {name}_c GROUP BY ALL))",
        f"{name}_l AS (SELECT {KEY}, list(s ORDER BY pos) AS sl, any_value({prominence}) AS least FROM {source} GROUP BY ALL)",
        f"{name}_e AS (SELECT {KEY}, pos, sl, least, sl[pos + 1] AS s, coalesce(list_max(list_filter(range(0, pos), lambda i: sl[i + 1] > sl[pos + 1])) + 1, 0) AS lo, coalesce(list_min(list_filter(range(pos + 1, len(sl)), lambda i: sl[i + 1] > sl[pos + 1])) - 1, len(sl) - 1) AS hi FROM {name}_d JOIN {name}_l USING ({KEY}))",
        f"{name}_f AS (SELECT *, list_min(sl[lo + 1:pos + 1]) AS ml, list_min(sl[pos + 1:hi + 1]) AS mr FROM {name}_e)",
        f"{name}_g AS (SELECT *, s - greatest(ml, mr) AS prom, list_max(list_filter(range(lo, pos + 1), lambda i: sl[i + 1] = ml)) AS lb, list_min(list_filter(range(pos, hi + 1), lambda i: sl[i + 1] = mr)) AS rb FROM {name}_f)",
        f"{name} AS MATERIALIZED (SELECT * FROM (SELECT *, {right} - ({left}) AS width FROM {name}_g WHERE prom >= least) WHERE width >= {width})",
    ]
