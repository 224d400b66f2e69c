"""Short loops over lists of dicts, written from the rules alone, as a second opinion on the plans."""

import datetime as dt


def newest(rows):
    return sorted(rows, key=lambda r: (-r["ts"].timestamp(), r["folder_name"]))


def oldest(rows):
    return sorted(rows, key=lambda r: (r["ts"], r["folder_name"]))


def preserved(rows, policy, daily, weekly, monthly):
    forms = [("%Y-%m-%d", daily), ("%Y-W%U", weekly), ("%Y-%m", monthly)]
    kept = set()
    for form, n in forms[: ["none", "daily", "weekly", "monthly"].index(policy)]:
        first = {}
        for r in newest(rows):
            first.setdefault(r["ts"].strftime(form), r["folder_name"])
        for key in sorted(first, reverse=True)[:n]:
            kept.add(first[key])
    return kept


def plan(rows, mode, days, count, cap, kept):
    reason = {}

    def free():
        return [r for r in rows if r["folder_name"] not in kept and r["folder_name"] not in reason]

    if mode in ("age_based", "advanced"):
        for r in free():
            if r["age_days"] > days:
                reason[r["folder_name"]] = "age"
    if mode in ("count_based", "advanced"):
        for r in newest(free())[count:]:
            reason[r["folder_name"]] = "count"
    if mode in ("size_based", "advanced"):
        total = sum(r["size_bytes"] for r in rows if r["folder_name"] not in reason)
        for r in oldest(free()):
            if total <= cap:
                break
            reason[r["folder_name"]] = "size"
            total -= r["size_bytes"]
    return reason


def emergency(rows, target):
    chosen, freed = [], 0
    for r in oldest(rows):
        if freed >= target:
            break
        chosen.append(r["folder_name"])
        freed += r["size_bytes"]
    return chosen


def random_catalog(rnd, n, as_of=dt.datetime(2024, 3, 1)):
    """Equal times, zero sizes, gaps, New Year weeks, future times, one location with most rows."""
    rows = []
    for i in range(n):
        ts = dt.datetime(2023, 11, 20) + dt.timedelta(days=rnd.choice([0, 1, 2, 40, 41, 42, 43, 80, 100, 105]),
                                                      seconds=rnd.choice([0, 0, 1, 3600, 7200]))
        rows.append({"location": rnd.choice("aaab"), "folder_name": f"backup_{ts:%Y-%m-%d_%H-%M-%S}_{rnd.randrange(16**4):04x}{i:04x}",
                     "ts": ts, "size_bytes": rnd.choice([0, 0, 1, 5, 50]), "age_days": (as_of - ts).days})
    return rows
