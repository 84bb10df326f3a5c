import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from heronry.llm import flat

texts = st.lists(st.one_of(st.none(), st.text(alphabet="ab Zé\n,9日", max_size=40)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(texts)
def test_words_are_those_of_a_regular_expression(rows):
    data, offs = flat.buffers(pa.array(rows, pa.string()))
    starts, ends, bounds = flat.spans(data, offs)
    got = [data[a:b].tobytes().decode() for a, b in zip(starts, ends)]
    each = [re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", t or "") for t in rows]
    assert got == [w for e in each for w in e]
    assert np.diff(bounds).tolist() == [len(e) for e in each]
    h = flat.hashes(data, starts, ends)
    assert len(set(h.tolist())) == len({w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in got})


def test_slices_of_offset_columns_and_long_texts():
    column = pa.array(["a b", None, "c d", "e" * 10, "f"]).slice(1, 4)
    data, offs = flat.buffers(column)
    assert data.tobytes() == b"c d" + b"e" * 10 + b"f" and offs.tolist() == [0, 0, 3, 13, 14]
    assert [(a, b) for a, b, _, _ in flat.slices(data, offs, 4)] == [(0, 2), (2, 3), (3, 4)]


def test_hashes_by_parts_are_those_of_the_whole():
    rnd = np.random.default_rng(0)
    data = rnd.integers(97, 110, 3 * flat.SLICE).astype(np.uint8)
    starts = np.sort(rnd.integers(0, len(data) - 100, 500))
    ends = starts + rnd.integers(0, 60, 500)
    ends[3] = starts[3] + flat.SLICE + 5
    by_one = [flat.hashes(data[a:b], np.array([0]), np.array([b - a]))[0] for a, b in zip(starts, ends)]
    assert (flat.hashes(data, starts, ends) == np.array(by_one)).all()


def test_runs():
    assert flat.runs(np.array([5, 1, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]
