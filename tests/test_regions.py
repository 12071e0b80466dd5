"""Text found on its page and merged to regions, against loops over small pages."""

import random
import re

from sparkloom.operators import regions as G

ITEM = "doc_id int, page int, idx int, str string, box struct<xmin:double,ymin:double,xmax:double,ymax:double>"
CHUNK = "doc_id int, page int, chunk_index int, content string"


def overlap(a0, a1, b0, b1):
    common, shorter = min(a1, b1) - max(a0, b0), min(a1 - a0, b1 - b0)
    return common / shorter if common > 0 and shorter > 0 else 0


def union(a, b):
    return (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))


def area(b):
    return max(0, b[2] - b[0]) * max(0, b[3] - b[1])


def joined(boxes, fits, last_only):
    out = []
    for b in boxes:
        k = next((i for i in range(len(out)) if (not last_only or i == len(out) - 1) and fits(out[i], b, max(b[3] - b[1], 1e-6))), None)
        if k is None:
            out.append(b)
        else:
            out[k] = union(out[k], b)
    return out


def columns(boxes):
    groups = [[b] for b in boxes]
    while True:
        pair = next(((i, j) for i in range(len(groups)) for j in range(i) if any(min(a[2], b[2]) > max(a[0], b[0]) for a in groups[i] for b in groups[j])), None)
        if not pair:
            whole = []
            for g in groups:
                w = g[0]
                for b in g[1:]:
                    w = union(w, b)
                whole.append(w)
            return sorted(whole)
        groups[pair[1]] += groups.pop(pair[0])


def plain(chunks, items):
    """chunk_index -> (idx of its items, regions, single box) of one page."""
    items = [(i, re.sub(r"\s", "", s or ""), b) for i, s, b in items]
    items = [x for x in items if x[1]]
    said, owner = "".join(x[1] for x in items), [k for k, x in enumerate(items) for _ in x[1]]
    out, begin = {}, 0
    for c, content in chunks:
        needle = re.sub(r"\s", "", content or "")
        at = said.find(needle, begin) if needle else -1
        at = said.find(needle) if needle and at < 0 else at
        if at < 0:
            continue
        begin = at
        mine = sorted(set(owner[at : at + len(needle)]))
        boxes = [items[k][2] for k in mine if items[k][2]]
        rows = joined(boxes, lambda o, b, h: overlap(o[1], o[3], b[1], b[3]) >= 0.5 and max(b[0] - o[2], o[0] - b[2]) <= 1.5 * h, True)
        found = joined(rows, lambda o, b, h: overlap(o[0], o[2], b[0], b[2]) >= 0.5 and max(b[1] - o[3], o[1] - b[3]) <= 1.5 * h, False)
        found = columns(found) if len(found) > 16 else found
        one = None
        if found and len(columns(found)) == 1:
            whole = columns(found)[0]
            one = whole if area(whole) > 0 and sum(map(area, found)) / area(whole) >= 0.65 else None
        out[c] = ([items[k][0] for k in mine], found, one)
    return out


def test_same_as_loops_over_random_pages(spark):
    rng = random.Random(11)
    items, chunks, want = [], [], {}
    for page in range(80):
        two, n = page % 2, rng.randrange(1, 60)
        its = []
        for i in range(n):
            row, col = (i // 2, i % 2) if two else (i // 3, i % 3)
            x = 0.05 + col * (0.5 if two else 0.15) + rng.choice([0, 0.01])
            y = 0.02 + row * rng.choice([0.015, 0.015, 0.05])
            box = None if rng.random() < 0.05 else (round(x, 3), round(y, 3), round(x + rng.choice([0.1, 0.3 if two else 0.12]), 3), round(y + 0.012, 3))
            its.append((i, rng.choice(["ab", "b c", "ab", " ", "x\ny", f"n{i}", None]), box))
        words = [s for _, s, _ in its if s and s.strip()]
        chs, a = [], 0
        for c in range(rng.randrange(1, 5)):
            b = min(len(words), a + rng.randrange(1, 30))
            chs.append((c, rng.choice([" ".join(words[a:b]), "\n\n".join(words[a:b]), "not there", None, ""]) if rng.random() < 0.3 else " ".join(words[a:b])))
            a = max(0, b - rng.randrange(0, 3))
        items += [(1, page, *x) for x in its]
        chunks += [(1, page, *x) for x in chs]
        want |= {(page, c): v for c, v in plain(chs, its).items()}
    rng.shuffle(items)
    its, chs = spark.createDataFrame(items, ITEM), spark.createDataFrame(chunks, CHUNK)
    at = {}
    for r in G.located(chs, its).collect():
        at.setdefault((r.page, r.chunk_index), []).append(r.idx)
    assert {k: sorted(v) for k, v in at.items()} == {k: v[0] for k, v in want.items()}
    got = {(r.page, r.chunk_index): r for r in G.with_boxes(chs, its).collect()}
    assert len(got) == len(chunks)
    near = lambda a, b: len(a) == len(b) and all(abs(x - y) < 1e-9 for p, q in zip(a, b) for x, y in zip(p, q))
    for key, r in got.items():
        _, found, one = want.get(key, ([], [], None))
        assert near([tuple(b) for b in r.boxes or []], found), key
        assert (r.bbox is None) == (one is None) and (one is None or near([tuple(r.bbox)], [one])), key
    assert sum(r.bbox is not None for r in got.values()) > 10 and max(len(r.boxes or []) for r in got.values()) > 1


def test_columns_are_never_joined(spark):
    items = [(1, 1, 2 * k + c, f"w{k}{'ab'[c]}", (0.05 + 0.5 * c, 0.1 + 0.02 * k, 0.45 + 0.5 * c, 0.115 + 0.02 * k)) for k in range(5) for c in range(2)]
    content = " ".join(s for _, _, _, s, _ in items)
    r = G.with_boxes(spark.createDataFrame([(1, 1, 0, content)], CHUNK), spark.createDataFrame(items, ITEM)).first()
    assert [round(b.xmin, 2) for b in r.boxes] == [0.05, 0.55] and r.bbox is None
    ragged = [(1, 1, k, f"r{k}", (0.1 + 0.2 * (k % 4), 0.04 * k, 0.15 + 0.2 * (k % 4), 0.04 * k + 0.005)) for k in range(24)]
    r = G.with_boxes(spark.createDataFrame([(1, 1, 0, " ".join(x[3] for x in ragged))], CHUNK), spark.createDataFrame(ragged, ITEM)).first()
    assert len(r.boxes) == 4 and r.bbox is None
