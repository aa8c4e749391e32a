"""Row-by-row models of the detectors, for comparison."""

from datetime import datetime, timedelta


def burst_model(rows, threshold, window_seconds, cooldown_seconds, scope):
    state, fired = {}, []
    window, cooldown = timedelta(seconds=window_seconds), timedelta(seconds=cooldown_seconds)
    for log_id, source, _, level, at in sorted(rows, key=lambda row: (row[4], row[0])):
        if level.upper() != "ERROR":
            continue
        key = source if scope else "all"
        anchor, count, alerted = state.get(key, (None, 0, None))
        if anchor is None or at - anchor > window:
            anchor, count = at, 1
        else:
            count += 1
            if count == threshold and (alerted is None or at - alerted > cooldown):
                alerted = at
                fired.append(log_id)
        state[key] = (anchor, count, alerted)
    return sorted(fired)


def repeat_model(rows, threshold, window_seconds, chars=30):
    """{trigger id: (count, ids of the newest logs)}"""
    recent, last, found = {}, {}, {}
    window = timedelta(seconds=window_seconds)
    for log_id, source, content, level, at in sorted(rows, key=lambda row: (row[4], row[0])):
        if level != "ERROR":
            continue
        key = (source, (content or "")[:chars])
        kept = [item for item in recent.get(key, []) if item[0] >= at - window] + [(at, log_id)]
        recent[key] = kept
        if len(kept) >= threshold and (key not in last or at - last[key] > window / 2):
            last[key] = at
            found[log_id] = (len(kept), [i for _, i in reversed(kept)][:10])
    return found


def random_logs(seed, size=600, seconds=900, sources="aaab"):
    import random
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    return [(i, rng.choice(sources), f"{'timeout while calling the payment service' if rng.random() < .8 else 'other'} {i}",
             rng.choice(["ERROR", "ERROR", "error", "INFO"]), start + timedelta(seconds=rng.randrange(seconds), microseconds=rng.choice([0, 0, 500_000])))
            for i in range(size)]
