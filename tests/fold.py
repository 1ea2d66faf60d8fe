"""The pyramid by adding one point after another: the brute force that other ways are compared with."""

NOTHING = (float("inf"), float("-inf"), 0.0, 0, 0.0, 0)


def merge(x, y):
    return (min(x[0], y[0]), max(x[1], y[1]), *(a + b for a, b in zip(x[2:], y[2:], strict=True)))


def folded(series, config):
    """Level rows (width, start, values) of the buckets that the points close."""
    rows, p = {}, None
    for t, v in series:
        p = t if p is None else p
        for b in range(p - p % config.interval_min, t + 1, config.interval_min):
            d = min(t, b + config.interval_min) - max(p, b)
            own = b == t - t % config.interval_min
            for w in config.levels:
                key = (w, b - b % w)
                rows[key] = merge(rows.get(key, NOTHING), (v, v, v if own else 0.0, int(own), v * d, d))
        p = t
    return sorted((w, b, *x) for (w, b), x in rows.items() if b + w <= p)
