import random
import re

from boardmill.llm.decontaminate import Q, ItemIndex, contaminated, decontaminated
from test_models import edit_distance


def found_plainly(item, text, budget):
    """Whether ``text`` holds ``item``: within the budget, or exactly and between word bounds if it is short."""
    if len(item) >= Q:
        return edit_distance(item, text) <= budget
    word = "[a-z0-9\u0080-\U0010ffff]"
    begin, end = (f"(?<!{word})" if re.match(word, item) else ""), (f"(?!{word})" if re.match(word, item[-1]) else "")
    return re.search(begin + re.escape(item) + end, text) is not None


def test_short_items_equal_brute_force(spark):
    rng = random.Random(5)
    pick = lambda n: " ".join(rng.choice(["no", "yes", "c++", "ab", "élan", "1914", "x"]) for _ in range(n))
    items = [(k, t) for k, t in enumerate(["no", "Yes", "c++", " 1914\n", "élan", "x", "no  x", "no x", "1234567", "12345678", "in 1914 yes", "yes c++ no 1914 x", "the quick brown fox jumps", "..", "zz"])]
    docs = [(k, pick(rng.randint(0, 12))) for k in range(60)]
    docs += [(100, "nobody eyes xx 19145"), (101, "in 1914\tYES"), (102, "a 12345678 b"), (103, "1234567"), (104, "no"), (105, "x"), (106, ""), (107, "so..on"), (108, "The quick brown fox jumps"), (109, "é no")]
    clean = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t).strip().lower()
    budgets = ItemIndex([i for i, _ in items], [t for _, t in items])
    budget = dict(zip(budgets.ids, budgets.budget.tolist(), strict=False))
    want = {(d, i) for d, t in docs for i, item in items if found_plainly(clean(item), clean(t), budget.get(i, 0))}
    frame = spark.createDataFrame(docs + [(500, None)], "doc_id long, text string")
    benchmark = spark.createDataFrame(items + [(90, ""), (91, " \n"), (92, None), (93, "no")], "item_id long, text string")
    got = contaminated(frame, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in got if r.item_id != 93} == want and len({i for _, i in want}) > 11
    assert {r.doc_id for r in got if r.item_id == 93} == {d for d, i in want if i == 0}
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})
    text = {d: clean(t) for d, t in docs}
    assert all(text[r.doc_id].encode()[r.begin : r.stop] == clean(dict(items)[r.item_id]).encode() for r in got if r.item_id < 10)
    assert {r.doc_id for r in decontaminated(frame, benchmark).collect()} == {d for d, _ in docs + [(500, 0)]} - {d for d, _ in want}
