"""Slow, plain restatements of the byte rules, used to check the batch kernels."""

from __future__ import annotations

import codecs
import statistics


def chi2(data: bytes) -> float:
    n = len(data)
    if n == 0:
        return 0.0
    return 256.0 * (sum(data.count(b) ** 2 for b in set(data)) / n) - n


def deltas(old: bytes, new: bytes, min_gap: int) -> list[tuple[int, int]]:
    n, out, i = min(len(old), len(new)), [], 0
    while i < n:
        if old[i] == new[i]:
            i += 1
            continue
        start = i
        while i < n:
            if old[i] != new[i]:
                i += 1
                continue
            j = i
            while j < n and old[j] == new[j]:
                j += 1
            if j - i > min_gap:
                break
            i = j
        out.append((start, i))
    if len(new) > n:
        out.append((n, len(new)))
    return out


def fixed_scan(data: bytes, width: int, stride: int, thr: float, passthrough=True) -> list[tuple]:
    out, pos, n = [], 0, len(data)
    while n >= width and pos + width <= n:
        c = chi2(data[pos: pos + width])
        if c <= thr:
            out.append((pos, pos + width, c))
            pos += width
        else:
            pos += stride
    if passthrough and 0 < n - pos < width:
        out.append((pos, n, 0.0))
    return out


def _spread(series, widths, least):
    big = [c for c, w in zip(series, widths) if w >= least]
    use = big if len(big) >= 2 else series
    return statistics.pvariance(use) if len(use) >= 2 else 0.0


def adaptive_scan(data: bytes, cfg) -> list[tuple[int, int]]:
    out, pos, n = [], 0, len(data)
    if n < cfg.width:
        return [(0, n)] if cfg.passthrough and n else []
    while pos + cfg.width <= n:
        tail = data[pos:]
        if chi2(tail[: cfg.width]) > cfg.chi2_threshold:
            pos += cfg.stride
            continue
        series, widths = [chi2(tail[: cfg.width])], [cfg.width]
        while widths[-1] * 2 <= len(tail) and chi2(tail[: widths[-1] * 2]) <= cfg.chi2_threshold:
            widths.append(widths[-1] * 2)
            series.append(chi2(tail[: widths[-1]]))

        def fits(w):
            c = chi2(tail[:w])
            return c <= cfg.chi2_threshold and _spread(series + [c], widths + [w], cfg.var_min_width) <= cfg.max_chi2_var

        w = None
        if len(widths) - 1 >= cfg.min_expansions:
            base = widths[-1]
            if fits(base):
                w, lo, hi = base, base, len(tail)
                while lo <= hi:
                    mid = (lo + hi) // 2
                    if fits(mid):
                        w, lo = mid, mid + 1
                    else:
                        hi = mid - 1
                while w < len(tail) and fits(w + 1):
                    w += 1
            else:
                s = base
                while s > cfg.width:
                    s = max(cfg.width, s // 2)
                    if fits(s):
                        break
                while s > cfg.width:
                    s = max(cfg.width, s - cfg.stride)
                    if fits(s):
                        w = s
                        break
        if w is None:
            pos += cfg.stride
        else:
            out.append((pos, pos + w))
            pos += w
    if cfg.passthrough and 0 < n - pos < cfg.width:
        out.append((pos, n))
    return out


def utf8_errors(data: bytes) -> int:
    errors, at = 0, 0
    while at < len(data):
        try:
            codecs.decode(data[at:], "utf-8", "strict")
            break
        except UnicodeDecodeError as ex:
            errors += 1
            at += ex.start + 1
    return errors


def islands(ids) -> set[tuple[int, int]]:
    out, ids = set(), sorted(set(ids))
    for i in ids:
        if i - 1 not in set(ids):
            e = i
            while e + 1 in set(ids):
                e += 1
            out.add((i, e))
    return out


def merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(x for x in spans if x[1] > x[0]):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]
