"""The search for a plan: complete where it says that it has ended."""

import random
import tracemalloc
from collections import Counter

from hushframe.llm import packing


def plan_of(pieces, length, steps=5_000):
    plan, ended = packing.search(Counter(pieces), length, steps)
    used = Counter()
    for filling, times in plan:
        assert sum(filling) <= length and times > 0
        for x in filling:
            used[x] += times
    assert used == Counter(pieces)
    return sum(t for _, t in plan), ended


def fewest(pieces, length):
    """By trying every place for every piece, largest first."""
    best, pieces = len(pieces), sorted(pieces, reverse=True)

    def put(i, room):
        nonlocal best
        if len(room) >= best:
            return
        if i == len(pieces):
            best = len(room)
            return
        for left in set(room):
            if left >= pieces[i]:
                k = room.index(left)
                put(i + 1, [*room[:k], left - pieces[i], *room[k + 1 :]])
        put(i + 1, [*room, length - pieces[i]])

    put(0, [])
    return best


def test_a_filling_is_not_used_as_often_as_it_can():
    assert plan_of([38, 37, 35, 26, 23, 10, 8, 7, 7, 5, 3, 1], 50) == (4, True)


def test_perfectly_packable_cases():
    rng, ended = random.Random(11), 0
    for _ in range(10_000):
        length, full, pieces = rng.choice([20, 50, 100]), rng.randint(2, 5), []
        for _ in range(full):
            left = length
            while left:
                pieces.append(min(left, rng.randint(1, length if rng.random() < 0.5 else length // 2)))
                left -= pieces[-1]
        size, done = plan_of(pieces, length)
        assert size == full or not done
        ended += done
    assert ended > 9_900


def test_other_cases_against_all_plans():
    rng = random.Random(5)
    for _ in range(600):
        length = rng.choice([10, 17, 30, 100])
        pieces = [rng.randint(max(1, length // rng.choice([3, 6, 20])), length) for _ in range(rng.randint(1, 10))]
        size, done = plan_of(pieces, length, 100_000)
        assert done and size == fewest(pieces, length)


def test_steps_that_run_out_leave_a_whole_plan():
    rng = random.Random(2)
    pieces = [rng.randint(200, 700) for _ in range(60)]
    size, done = plan_of(pieces, 1000, 3)
    assert size >= plan_of(pieces, 1000, 20_000)[0] >= -(-sum(pieces) // 1000)


def test_search_of_all_lengths_needs_little_memory():
    """A node of the search for each length or so, and nothing as large as the histogram in each."""
    histogram = {x: 1 + 3_000_000 * (x * 7919 % 101) // (x + 200) ** 2 for x in range(1, 2048)}
    tracemalloc.start()
    try:
        packing.search(histogram, 2048, 2_000)
        assert tracemalloc.get_traced_memory()[1] < 50e6
    finally:
        tracemalloc.stop()
