import gzip
import io
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from kinetika.llm import language, packing, sharding, textarrays, warc

texts = st.lists(st.one_of(st.none(), st.text(max_size=60)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(texts)
def test_words_are_runs_of_letters_and_digits(values):
    points, offsets = textarrays.code_points(pa.array(values, pa.string()))
    starts, ends, of_text = textarrays.words(points, offsets)
    for i, t in enumerate(values):
        own = range(of_text[i], of_text[i + 1])
        assert ["".join(map(chr, points[starts[j] : ends[j]])) for j in own] == re.findall(r"[^\W_]+", t or "")
        assert "".join(map(chr, points[offsets[i] : offsets[i + 1]])) == (t or "")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "b c", "d e f g h", "a b c d e f g", "", "!", None]), max_size=8))
def test_shingles_depend_on_the_text_alone(values):
    together, bounds = textarrays.shingles(pa.array(values, pa.string()), wordless=True)
    for i, t in enumerate(values):
        assert together[bounds[i] : bounds[i + 1]].tolist() == textarrays.shingles(pa.array([t], pa.string()), wordless=True)[0].tolist()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=60))
def test_every_piece_is_packed_once(lengths):
    counts = np.bincount(lengths, minlength=65)
    bins = packing.patterns(counts, 64)
    total = np.zeros(65, int)
    for chosen, times in bins:
        assert sum(k * n for k, n in chosen.items()) <= 64
        for k, n in chosen.items():
            total[k] += n * times
    assert (total == counts).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=200), st.integers(1, 12))
def test_a_grown_map_moves_slots_to_the_new_shard_alone(sizes, shards):
    first = sharding.SlotMap.start(len(sizes), shards).rebalance(sizes)
    second = first.grow()
    assert all(b in (a, shards) for a, b in zip(first.shard_of, second.shard_of, strict=True)) and sum(second.loads()) == sum(sizes)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 1 << 40), st.text(max_size=40), st.binary(max_size=200), st.booleans())
def test_records_are_read_as_written(page, url, payload, revisit):
    url = url.encode("utf-8", "ignore").decode()
    digest = warc.payload_digest(payload)
    member = warc.page_record(page, url, payload, digest, (7, "there") if revisit else None)
    (headers, block), = warc.records(io.BytesIO(member + gzip.compress(b"")))
    first = next(warc.records(io.BytesIO(warc.page_record(7, "there", payload, digest))))[0]
    assert headers.get("warc-refers-to") == (first["warc-record-id"] if revisit else None) and headers.get("warc-refers-to-target-uri") == ("there" if revisit else None)
    assert headers["x-page-id"] == str(page) and headers["warc-payload-digest"] == f"sha1:{warc.payload_digest(payload)}"
    assert block.partition(b"\r\n\r\n")[2] == (b"" if revisit else payload) and headers["warc-type"] == ("revisit" if revisit else "response")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc xy!"), max_size=80).map("".join))
def test_a_learned_text_is_a_phrase_a_block(text):
    model = language.LanguageModel({"x": [text], "y": ["zzz"]}, 200)
    cost, letters = model.costs(pa.array([text]))
    symbols = model.encode(pa.array([text]))[0]
    if len(symbols) and len(symbols) <= 200:
        assert cost[0, 0] * len(symbols) <= model.bits[0] + 1e-9
    assert letters[0] == sum(c.isalpha() for c in text)
