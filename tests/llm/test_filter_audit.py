import re
from itertools import permutations

from llm_fixtures import empty, odd, odd_rows, small  # noqa: F401
from tickloom.llm import filter_audit, queries

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def plain(rows, labels):
    """The filters applied one after the other, document by document."""
    fails = []
    for doc_id, text, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails.append({
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": any(i is not None and (doc_id is None or i < doc_id) and (t or "") == text for i, t, *_ in rows),
        })
    good = {i for i, quality, _ in labels if quality == 1 and i is not None}
    toxic = {i for i, _, bad in labels if bad == 1 and i is not None}
    out, shapley = {}, {}
    for part in {r[2] or "" for r in rows}:
        for order in permutations("ABCDE"):
            left = [k for k, r in enumerate(rows) if (r[2] or "") == part]
            every = list(left)
            for step, f in enumerate(order, 1):
                removed = [k for k in left if fails[k][f]]
                redundant = [k for k in every if k not in left and fails[k][f]]
                left = [k for k in left if not fails[k][f]]
                alone = [k for k in every if [g for g in fails[k] if fails[k][g]] == [f]]
                shapley[part, f] = shapley.get((part, f), 0) + len(removed)
                out[part, "".join(order), step] = [
                    len(left), len(removed), len(redundant), len(alone), sum(rows[k][0] in good for k in removed), sum(rows[k][0] in toxic for k in removed)
                ]
    return sorted((*key, *figures, shapley[key[0], key[1][key[2] - 1]]) for key, figures in out.items())


def test_small_table(spark):
    long = " ".join(f"w{i}" for i in range(120))
    rows = [
        (1, long, "en", "a", 1), (2, long, "de", "a", 1), (3, long, "en", "a", 1), (4, "w " * 150, "en", "a", 1), (5, "ABC DEF", "en", "a", 1), (6, "a # b", "de", "a", 1),
        (7, long + " $", "de", "a", 1), (8, long + "\x0bX\x1cY z", None, "a", 1), (9, "ABC DEF", "", "a", 1), (9, long, "en", "a", 1), (None, long, "en", "a", 1), (None, "no other", "en", "a", 1),
    ]
    labels = [(1, 1, 0), (3, 1, 1), (3, 0, 0), (5, 0, 1), (6, 1, 1), (8, None, 1), (None, 1, 1), (99, 1, 1)]
    docs, marks = spark.createDataFrame(rows, COLUMNS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    assert sorted(map(tuple, filter_audit.audit(docs, marks).collect())) == plain(rows, labels)


def test_odd_rows_and_empty_table(spark, odd, empty):
    marks = spark.createDataFrame([(i, i % 2, i % 3 == 0) for i in range(9)], "doc_id bigint, quality int, toxic boolean").selectExpr("doc_id", "quality", "int(toxic) AS toxic", "1 AS cell")
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(9)]
    assert sorted(map(tuple, filter_audit.audit(odd, marks).collect())) == plain(odd_rows(), labels)
    assert filter_audit.audit(empty, marks).collect() == []
    assert sorted(map(tuple, filter_audit.audit(odd, marks.limit(0)).collect())) == plain(odd_rows(), [])


def test_shares_add_up(spark, small):
    """Over all orders the five shares of a part make up all documents it loses, 120 times."""
    rows = queries.op12_filter_audit(spark, small).collect()
    for part in {r.part for r in rows}:
        mine = [r for r in rows if r.part == part]
        assert len(mine) == 600
        lost = {r.kept + sum(x.removed for x in mine if x.filter_order == r.filter_order) for r in mine if r.step == 5}
        kept = {r.kept for r in mine if r.step == 5}
        assert len(lost) == len(kept) == 1
        shares = {r.filter_order[r.step - 1]: r.shapley for r in mine}
        assert sum(shares.values()) == 120 * (lost.pop() - kept.pop())
