"""Kept views against recomputation."""

import random

from quillgrid.streaming.views import MatchedView

LEFT, RIGHT = "id int, k string, v int, op string", "k string, op string"


def rows(df):
    return sorted(((r.id, r.k, r.v) for r in df.collect()), key=repr) if df is not None else []


def test_view_follows_random_changes_and_repeats(spark, tmp_path):
    rng = random.Random(5)
    view = MatchedView(spark, f"file://{tmp_path}/v", ["k"], ["id"])
    left, right = {}, []
    keys = ["a", "b", "c", None]
    for number in range(7):
        to_left, to_right = [], []
        if number != 2:
            for i in rng.sample(range(8), 3):
                if i in left and rng.random() < 0.4:
                    to_left.append((i, None, None, "delete"))
                    del left[i]
                else:
                    left[i] = (rng.choice(keys), rng.randrange(9))
                    to_left.append((i, *left[i], "insert"))
        if number == 4:  # the right side goes empty, and comes back
            to_right, right = [(k, "delete") for k in right], []
        elif number not in (0, 3):
            for k in rng.choices(keys, k=2):
                to_right.append((k, "insert"))
                right.append(k)
            if number > 5 and right:
                to_right.append((right.pop(0), "delete"))
        changes = {"left": spark.createDataFrame(to_left, LEFT) if to_left else None, "right": spark.createDataFrame(to_right, RIGHT) if to_right else None}
        view.apply(number, **changes)
        if number % 3 == 1:
            view.apply(number, **changes)
        every = sorted(((i, *r) for i, r in left.items()), key=repr)
        want = [r for r in every if r[1] is not None and r[1] in right]
        assert rows(view.matched()) == want, number
        assert rows(view.unmatched()) == [r for r in every if r not in want], number
        assert rows(view.matched_or_all()) == (want if right else every), number
