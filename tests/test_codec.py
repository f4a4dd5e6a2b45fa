"""The codec's arithmetic against published vectors, and as its own inverse."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridwave.codec import blocks, grid, headers, mq, vectors, wavelet
from gridwave.codec.bits import BitReader, BitWriter, TagTree, read_passes, write_passes
from gridwave.codec.faults import Fault
from gridwave.queries import _broken


def test_mq_worked_sequence():
    decide = mq.decoder(bytes.fromhex(vectors.H2_CODED), [0])
    bits = [decide(0) for _ in range(256)]
    assert int("".join(map(str, bits)), 2) == int(vectors.H2_DECODED, 16)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 1)), max_size=300))
def test_mq_round_trip(decisions):
    e = mq.Encoder([0] * 4)
    for k, d in decisions:
        e(k, d)
    decide = mq.decoder(e.done(), [0] * 4)
    assert [decide(k) for k, _ in decisions] == [d for _, d in decisions]


def test_past_the_end_is_defined():
    decide = mq.decoder(b"", [0])
    assert {decide(0) for _ in range(50)} <= {0, 1}


@pytest.mark.parametrize("block", vectors.GOLDEN_BLOCKS, ids=lambda b: b[0])
def test_golden_blocks(block):
    name, w, h, passes, zero, segment, want = block
    q = blocks.decode_block(bytes.fromhex(segment), w, h, "LL", -(-passes // 3) + zero, zero, passes)
    assert q.ravel().tolist() == list(want)
    stream = vectors.wrapped(name)
    assert hashlib.sha256(stream).hexdigest() == vectors.WRAPPED_SHA256[name]
    _, image = grid.decode(stream)
    assert (image.ravel() - 128).tolist() == list(want)


def test_truncated_block_keeps_mid_points():
    *_, segment, want = vectors.GOLDEN_BLOCKS[0]
    q = blocks.decode_block(bytes.fromhex(segment), 8, 8, "LL", 9, 2, 10)
    assert np.abs(q.ravel() - np.array(want)).max() <= 16 and (q % 2 == 0).all()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 12), st.integers(1, 12), st.sampled_from(("LL", "HL", "LH", "HH")), st.integers(0, 2**31))
def test_block_round_trip(w, h, kind, seed):
    r = np.random.default_rng(seed)
    x = (r.normal(size=(h, w)) * r.choice((1, 20, 3000))).astype(np.int64)
    segment, zero, passes = blocks.encode_block(x, kind, 20)
    assert (blocks.decode_block(segment, w, h, kind, 20, zero, passes) == x).all()


def test_stuffing_and_alignment():
    b = BitReader(bytes.fromhex("ff7f80"))
    assert b.bits(8) == 255 and b.bits(7) == 127 and b.bit() == 1 and b.align() == 3
    b = BitReader(bytes.fromhex("ff12"))
    assert b.bits(3) == 7 and b.align() == 2  # partly read, but the byte after it is stuffed
    assert BitReader(b"").bits(5) == 31


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=80))
def test_bits_round_trip(bits):
    w = BitWriter()
    for b in bits:
        w.bit(b)
    data = w.done()
    r = BitReader(data + b"\x55")
    assert [r.bit() for _ in bits] == bits
    if bits:
        assert r.align() == len(data)


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 9), st.integers(1, 7), st.data())
def test_tag_tree_round_trip(cols, rows, data):
    leaves = data.draw(st.lists(st.integers(0, 9), min_size=cols * rows, max_size=cols * rows))
    w, tree = BitWriter(), TagTree(cols, rows, leaves)
    for i, v in enumerate(leaves):  # first below 4, then in full: the state carries over
        tree.write(i % cols, i // cols, 4, w)
        tree.write(i % cols, i // cols, v + 1, w)
    r, tree = BitReader(w.done()), TagTree(cols, rows)
    for i, v in enumerate(leaves):
        assert tree.read(i % cols, i // cols, 4, r) == (v if v < 4 else None)
        assert tree.read(i % cols, i // cols, 64, r) == v


def test_pass_counts():
    for n in range(1, 165):
        w = BitWriter()
        write_passes(n, w)
        assert read_passes(BitReader(w.done())) == n


def test_known_53_vector_and_signs():
    assert wavelet.inverse_53(np.array([10, 0, 33, 10])).tolist() == [10, 20, 30, 40]
    assert wavelet.to_samples(np.array([0.5, -0.5, 1.5, 2.4, np.inf, np.nan], np.float32)).tolist() == [1, -1, 2, 2, 2**31 - 1, 0]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-4000, 4000), min_size=1, max_size=40))
def test_lifting_round_trips(x):
    x = np.array(x)
    assert (wavelet.inverse_53(wavelet.forward_53(x)) == x).all()
    assert np.abs(wavelet.inverse_97(wavelet.forward_97(x)) - x).max() < 0.05


SHAPES = [(1, 1, 0), (1, 1, 3), (1, 9, 2), (9, 1, 2), (2, 2, 1), (13, 7, 2), (16, 31, 5), (65, 93, 3), (70, 64, 5), (33, 130, 4)]


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("transform", ["5-3", "9-7"])
def test_grid_round_trip(shape, transform):
    h, w, levels = shape
    r = np.random.default_rng(h * w)
    x = np.clip(np.add.outer(np.arange(h) * 5, np.arange(w) * 3) + r.integers(-4, 5, (h, w)), 0, 4095)
    head, y = grid.decode(grid.encode(x, 12, False, levels, transform, xcb=2, ycb=1))
    assert (head.width, head.height) == (w, h)
    assert np.abs(y - x).max() <= (0 if transform == "5-3" else 2)


def test_signed_and_deep():
    r = np.random.default_rng(3)
    for depth in (1, 8, 16, 24):
        x = r.integers(-(1 << depth - 1), 1 << depth - 1, (6, 5))
        assert (grid.decode(grid.encode(x, depth, True, 1, guard=3))[1] == x).all()


@pytest.mark.parametrize("case", _broken(), ids=lambda c: c[0])
def test_fault_kinds(case):
    _, kind, data = case
    if not kind:
        grid.decode(data)
        return
    with pytest.raises(Fault) as e:
        grid.decode(data)
    assert e.value.kind == kind


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_hostile_bytes_give_faults(data):
    """Any change to a stream decodes or raises a Fault."""
    x = bytearray(vectors.wrapped(data.draw(st.sampled_from([b[0] for b in vectors.GOLDEN_BLOCKS]))))
    for _ in range(data.draw(st.integers(1, 4))):
        x[data.draw(st.integers(0, len(x) - 1))] = data.draw(st.integers(0, 255))
    try:
        if headers.parse(bytes(x)).siz["x_size"] * headers.parse(bytes(x)).siz["y_size"] < 10_000:
            grid.decode(bytes(x))
    except Fault:
        pass


def test_geometry_limits():
    assert [(b.w, b.h) for b in grid.band_grids(5, 3, 1, 4, 4)] == [(3, 2), (2, 2), (3, 1), (2, 1)]
    for args, kind in (((4, 4, 33, 4, 4), "Unsupported"), ((0, 4, 1, 4, 4), "Codestream"), ((4, 4, 1, 9, 0), "Marker"), ((4, 4, 1, 5, 4), "Marker")):
        with pytest.raises(Fault) as e:
            grid.band_grids(*args)
        assert e.value.kind == kind


def test_derived_steps_fall_by_level():
    q = {"style": "derived", "guard_bits": 1, "steps": [(3, 7)]}
    assert [grid.band_step(q, b) for b in (0, 1, 3, 4, 7, 20)] == [(3, 7), (3, 7), (3, 7), (2, 7), (1, 7), (0, 7)]
    with pytest.raises(Fault):
        grid.bit_planes({"style": "none", "guard_bits": 1, "steps": [(3, 0)]}, 1)
