"""Published example matrices and what is known of them."""

HIERO = {
    "features": ["get", "see", "use", "hear", "eat", "kill"],
    "rows": {
        "knife": [51, 20, 84, 0, 3, 0], "cat": [52, 58, 4, 4, 6, 26], "dog": [115, 83, 10, 42, 33, 17], "boat": [59, 39, 23, 4, 0, 0],
        "cup": [98, 14, 6, 2, 1, 0], "pig": [12, 17, 3, 2, 9, 27], "banana": [11, 2, 2, 0, 18, 0],
    },
}
CONTEXT = {
    "features": ["Felidae", "Pet", "Feral", "Boat", "Philosophy", "Kant", "Back_Pain"],
    "rows": {
        "cat": [10, 10, 7, 0, 0, 0, 0], "dog": [0, 10, 4, 11, 0, 0, 0], "animal": [2, 15, 10, 0, 0, 0, 0], "time": [1, 0, 0, 2, 2, 1, 0],
        "reason": [0, 1, 0, 0, 1, 4, 1], "cause": [0, 0, 0, 2, 1, 2, 6], "effect": [0, 0, 0, 1, 0, 1, 0],
    },
}
TERM = {
    "features": ["breed", "tail", "feed", "kill", "important", "explain", "likely"],
    "rows": {
        "cat": [84, 17, 8, 38, 0, 2, 0], "dog": [579, 14, 32, 63, 1, 2, 2], "animal": [45, 11, 86, 136, 13, 5, 4], "time": [19, 8, 29, 134, 94, 44, 100],
        "reason": [1, 0, 1, 18, 71, 140, 39], "cause": [0, 1, 0, 3, 55, 35, 51], "effect": [0, 1, 1, 6, 62, 37, 14],
    },
    "f": dict(cat=22007, dog=50807, animal=77053, time=1156693, reason=95047, cause=54739, effect=133102),
    "g": dict(breed=10329, tail=6511, feed=8307, kill=49534, important=53824, explain=17939, likely=11096),
    "N": 199902178,
}


def triplets(spark, m):
    rows = [(t, f, float(v), 100 * i + j) for i, (t, vs) in enumerate(m["rows"].items()) for j, (f, v) in enumerate(zip(m["features"], vs, strict=True)) if v]
    return spark.createDataFrame(rows, "target string, feature string, f double, line long")


def model(spark, m):
    from termfield.model import from_triplets

    info = [spark.createDataFrame([(k, float(v)) for k, v in m[s].items()], "term string, f double") if s in m else None for s in ("f", "g")]
    return from_triplets(triplets(spark, m), rowinfo=info[0], colinfo=info[1], N=m.get("N"), order="line")


def row(df, term, features, value="score"):
    got = {r["feature"]: r[value] for r in df.where(f"target = '{term}'").collect()}
    return [got.get(f, 0.0) for f in features]
