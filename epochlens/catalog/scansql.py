"""The adaptive window search as SQL: one recursion step per region, everything inside a step as list expressions."""

from __future__ import annotations

from epochlens.operators.scan import ScanConfig


def adaptive_sql(cfg: ScanConfig) -> str:
    """CTEs from ``base(id, b, n)``, ``b`` a list of ``n`` byte values, to ``stretch(id, start, stop, lo, hi, var, final)``."""
    limit, most = cfg.chi2_threshold, cfg.max_chi2_var

    def chi(pos: str, width: str) -> str:
        counts = f"map_values(list_histogram(list_slice(b, {pos} + 1, {pos} + ({width}))))"
        return f"(256.0::DOUBLE * (list_sum(list_transform({counts}, lambda c: c * c))::DOUBLE / ({width})) - ({width}))"

    def spread(width: str, value: str) -> str:
        """Only wide windows count, if there are two of them with the tried one."""
        return (f"(CASE WHEN {width} >= {cfg.var_min_width} AND len(wide) >= 1 THEN list_var_pop(list_append(wide, {value}))"
                f" WHEN len(wide) >= 2 THEN list_var_pop(wide) ELSE list_var_pop(list_append(series, {value})) END)")

    def accepted(width: str) -> str:
        value = chi("pos", width)
        return f"({value} <= {limit} AND {spread(width, value)} <= {most})"

    middle = "((s[1] + s[2]) // 2)"
    wide_from = max(1, (cfg.var_min_width // cfg.width).bit_length())
    doubled = [cfg.width << k for k in range(cfg.min_expansions + 1)]
    fits = " AND ".join(f"pos + {w} <= n AND {chi('pos', str(w))} <= {limit}" for w in doubled)
    return f"""
    place AS (SELECT id, unnest(range(0, n - {cfg.width} + 1)) AS pos FROM base WHERE n >= {cfg.width}),
    seed AS (SELECT id, list(pos) AS seeds FROM place JOIN base USING (id) WHERE {fits} GROUP BY id),
    given AS (SELECT base.*, seeds FROM base JOIN seed USING (id)),
    walk(id, upto, start, w, lo, hi, var, final) AS (
        SELECT id, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE
        FROM given
        UNION ALL
        SELECT id, CASE WHEN w IS NULL THEN pos + {cfg.stride} ELSE pos + w END, pos, w, list_min(series), list_max(series),
               {spread("w", chi("pos", "w"))}, {chi("pos", "w")}
        FROM (
            SELECT *, CASE
                WHEN climbs AND rejected IS NULL THEN n - pos WHEN climbs THEN rejected - 1 ELSE (
                    list_filter(list_transform(range(1, (half - {cfg.width} + {cfg.stride} - 1) // {cfg.stride} + 1),
                                lambda k: greatest({cfg.width}, half - {cfg.stride} * k)), lambda v: {accepted("v")}))[1] END AS w
            FROM (
                SELECT *, CASE WHEN climbs THEN list_filter(range(reached + 1, n - pos + 1), lambda v: NOT {accepted("v")})[1] END AS rejected,
                       CASE WHEN NOT climbs THEN coalesce(list_filter(halves, lambda v: v > {cfg.width} AND {accepted("v")})[1], {cfg.width}) END AS half
                FROM (
                    SELECT *, CASE WHEN climbs THEN list_reduce(
                            list_transform(range(1, 2 + ceil(log2(n - pos + 1))::INT), lambda k: [k, k, k]), lambda s, k:
                                CASE WHEN s[1] > s[2] THEN s WHEN {accepted(middle)} THEN [{middle} + 1, s[2], {middle}]
                                     ELSE [s[1], {middle} - 1, s[3]] END, [top, n - pos, top])[3] END AS reached,
                           list_transform(range(1, len(series)), lambda k: greatest({cfg.width}, top >> k)) AS halves
                    FROM (
                        SELECT *, {accepted("top")} AS climbs FROM (
                            SELECT *, series[{wide_from}:] AS wide, {cfg.width}::BIGINT << (len(series) - 1) AS top FROM (
                                SELECT id, b, n, pos, ladder[:coalesce(list_position(list_transform(ladder, lambda v: v > {limit}), TRUE) - 1,
                                                                       len(ladder))] AS series FROM (
                                    SELECT id, b, n, pos, list_transform(range(0, floor(log2((n - pos) / {cfg.width}))::INT + 1),
                                               lambda k: {chi("pos", f"({cfg.width}::BIGINT << k)")}) AS ladder
                                    FROM (SELECT given.id, b, n, list_min(list_filter(seeds, lambda p: p >= upto AND (p - upto) % {cfg.stride} = 0)) AS pos
                                          FROM walk JOIN given ON walk.id = given.id)
                                    WHERE pos IS NOT NULL)))))))
    ),
    ended AS (SELECT id, n, coalesce(upto, 0) AS upto FROM base LEFT JOIN (SELECT id, max(upto) AS upto FROM walk GROUP BY id) USING (id)),
    rest AS (SELECT id, n, CASE WHEN upto <= n - {cfg.width} THEN upto + ((n - {cfg.width} - upto) // {cfg.stride} + 1) * {cfg.stride} ELSE upto END AS upto
             FROM ended),
    stretch AS (
        SELECT id, start, start + w AS stop, lo, hi, var, final FROM walk WHERE w IS NOT NULL
        UNION ALL SELECT id, CASE WHEN n < {cfg.width} THEN 0 ELSE upto END, n, 0.0, 0.0, 0.0, 0.0 FROM rest
        WHERE n > 0 AND (n < {cfg.width} OR (n > upto AND n - upto < {cfg.width})))"""
