import random

from lectern.operators import meta


def fill(effects, rounds=None):
    """(missing, centre, rounds) of equally weighted effects, iterated until the number settles."""
    k, missing, seen = len(effects), 0, [0]
    high = sorted(effects, reverse=True)
    centre = sum(effects) / k
    while True:
        gaps = [e - centre for e in effects]
        t = sum(1 + sum(abs(h) < abs(g) for h in gaps) for g in gaps if g > 0)
        now = min(max(0, int((4 * t - k * (k + 1)) / (2 * k - 1) + 0.5)), k - 1)
        rest = high[now:]
        centre = sum(rest) / len(rest)
        if now == missing or len(seen) == rounds:
            return now, centre, len(seen)
        if now in seen:
            return None
        missing = now
        seen.append(now)


def test_trim_and_fill_goes_on_until_settled(spark):
    rng = random.Random(3)
    groups = []
    while len(groups) < 2:
        effects = [rng.gauss(0, 1) for _ in range(80)]
        want = fill(effects)
        if want and want[2] > 6 and fill(effects, 5)[0] != want[0]:
            groups.append((effects, want))
    rows = [(g, e, 0.5) for g, (effects, _) in enumerate(groups) for e in effects]
    got = meta.trim_and_fill(spark.createDataFrame(rows, "g int, effect double, se double"), "g").collect()
    assert len(got) == len(groups)
    for r in got:
        missing, centre, _ = groups[r.g][1]
        assert r.converged and r.missing == missing and abs(r.adjusted - centre) < 1e-9
