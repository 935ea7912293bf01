import json
import random
from datetime import datetime

from hypothesis import given
from hypothesis import strategies as st

from sedimenta.operators.snapshots import same_json, snapshot_changes

SCHEMA = "snapshot_no int, source_path string, chunk_index int, chunk_id string, meta_json string, loaded_at timestamp, snapshot string, leaf int"


def found(spark, rows, **k):
    df = spark.createDataFrame([(*r, "extra", 7) for r in rows], SCHEMA)
    return sorted(snapshot_changes(df, **k).collect(), key=repr)


def brute(rows):
    best = {}
    for s, p, i, c, m, at in rows:
        key, r = (s, p, i), (at or datetime.min, c or "", m or "", c, m)
        best[key] = max(best.get(key, r), r, key=lambda x: x[:3])
    numbers, out = sorted({r[0] for r in rows if r[0] is not None}), set()
    for a, b in zip(numbers, numbers[1:]):
        old, new = ({k[1:]: v[3:] for k, v in best.items() if k[0] == n} for n in (a, b))
        for k in old.keys() | new.keys():
            kind = "added" if k not in old else "removed" if k not in new else None
            if kind is None:
                (c0, m0), (c1, m1) = old[k], new[k]
                same = c0 == c1 and (m0 == m1 or m0 is not None and m1 is not None and json.loads(m0) == json.loads(m1))
                kind = None if same else "changed"
            if kind:
                out.add((b, *k, kind))
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for s in (1, 2, 5, 9):
        for i in range(120):
            if rng.random() < 0.8:
                for _ in range(rng.choice((1, 1, 2))):
                    meta = {"a": rng.randint(0, 1), "b": [1, "x"]}
                    text = rng.choice([None, json.dumps(meta), json.dumps(dict(reversed(meta.items())), indent=1)])
                    rows.append((s, rng.choice("pq"), i % 40, f"c{rng.randint(0, 2)}", text, datetime(2025, 1, 1, 0, 0, rng.randint(0, 59))))
    for bits in (0, 3, 12):
        got = [tuple(r) for r in found(spark, rows, leaf_bits=bits)] if bits else None
        if got is not None:
            assert set(got) == brute(rows) and len(got) == len(set(got))


def test_edges(spark):
    assert found(spark, []) == []
    t = datetime(2025, 1, 1)
    assert found(spark, [(1, "a", 0, "x", None, t)]) == [], "the first snapshot has no cases"
    rows = [(1, "a", 0, "x", None, t), (3, "a", 0, "x", "null", t), (3, None, None, None, None, None), (None, "b", 0, "y", None, t)]
    assert [tuple(r) for r in found(spark, rows)] == [(3, "a", 0, "changed"), (3, None, None, "added")]
    big = json.dumps({"k": "v" * 200_000})
    assert found(spark, [(1, "a", 0, "x", big, t), (2, "a", 0, "x", big.replace(": ", ":"), t), (2, "a", 0, "x", big, t)]) == []


def test_same_json():
    assert same_json('{"a": 1, "b": [true, null]}', '{"b":[true,null],"a":1.0}')
    assert not same_json('{"a": 1}', '{"a": true}') and not same_json("[1, 2]", "[2, 1]") and not same_json("[]", "{}")
    assert same_json('"caf\\u00e9"', '"café"') and same_json("1e2", "100")
    assert same_json("{", "{") and not same_json("{", "{ ")


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x), max_leaves=12))
def test_spelling_doesnt_matter(value):
    assert same_json(json.dumps(value), json.dumps(value, indent=3, ensure_ascii=False, sort_keys=True))
