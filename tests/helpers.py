"""Small logs and plain-Python forms of the features."""

import random
from datetime import datetime, timedelta

SCHEMA = ("customer_id string, transaction_id string, timestamp timestamp, amount double,"
          " merchant_category string, device_id string, location string,"
          " failed_logins_24h int, is_fraud int")

START = datetime(2024, 3, 1, 9, 0, 0)


def row(customer="c", number=0, at=START, amount=100.0, category="grocery", device="d",
        location="Mumbai", logins=0, fraud=0):
    return (customer, f"t{number:05d}", at, amount, category, device, location, logins, fraud)


def random_log(customers=4, rows=60, seed=7):
    """Logs with equal times, gaps near one hour, repeated and null devices."""
    pick = random.Random(seed)
    out, number = [], 0
    for c in range(customers):
        at = START
        for _ in range(rows):
            at += timedelta(seconds=pick.choice([0, 0, 60, 900, 3599, 3600, 3601, 40000]))
            out.append(row(
                f"c{c}", number, at, round(pick.uniform(1, 900), 2),
                pick.choice(["grocery", "fuel", "travel"]),
                pick.choice(["d1", "d2", f"x{number}", None]),
                pick.choice(["Mumbai", "Pune", "Lagos"]), pick.randint(0, 3),
                int(pick.random() < 0.1)))
            number += 1
    return out


def plain_features(rows, home):
    """transaction_id -> the nine features, by looping over each earlier row."""
    out, by_customer = {}, {}
    for r in rows:
        by_customer.setdefault(r[0], []).append(r)
    for group in by_customer.values():
        group.sort(key=lambda r: (r[2], r[1]))
        for i, r in enumerate(group):
            past = group[:i]
            amounts = [p[3] for p in past]
            mean = sum(amounts) / i if i else r[3]
            if i > 1:
                std = (sum((a - mean) ** 2 for a in amounts) / i) ** 0.5
            else:
                std = max(0.3 * mean, 1.0)
            std = max(std, 0.1 * mean, 1.0)
            same_hour = sum(p[2].hour == r[2].hour for p in past)
            same_kind = sum(p[4] == r[4] for p in past)
            out[r[1]] = [
                min(max((r[3] - mean) / std, -10.0), 10.0),
                int(i > 0 and same_hour / i < 0.05),
                int(all(p[5] != r[5] for p in past)),
                int(all(p[6] != r[6] for p in past)),
                int(r[6] not in home),
                r[7],
                int(i == 0 or same_kind / i < 0.05),
                sum(abs((r[2] - p[2]).total_seconds()) <= 3600 for p in past),
                min(max(r[3] / max(mean, 1e-6) * 100, 0.0), 1000.0),
            ]
    return out


def by_id(df, columns):
    return {r["transaction_id"]: [r[c] for c in columns] for r in df.collect()}


def close(a, b, tolerance=1e-9):
    if isinstance(a, (list, tuple)):
        return len(a) == len(b) and all(close(x, y, tolerance) for x, y in zip(a, b))
    if a is None or b is None or isinstance(a, str):
        return a == b
    return abs(a - b) <= tolerance * max(1.0, abs(a), abs(b))
