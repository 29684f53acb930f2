"""Token shards, document shards and web archives."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lorespark.llm import shards, token_store, warc
from lorespark.llm.memo import WordMemo
from lorespark.session import shared_folder
from tests.llm.helpers import docs, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", None, "a", " lead", "trail ", "two  spaces", "x\n y", "it's\tfine", "é漢字🙂 ünï", "a" * 5000,
         "<|endoftext|> is text", prose(1, 3000), "line one.\nLine two,\nlast", "\n\n", "same", "same"]


def tokenizer():
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(PATH)
    out.encode_special_tokens = True
    return out


def test_tokens_equal_the_library_in_order(spark):
    rows = [(i * 7 % 101, t) for i, t in enumerate(TEXTS)] + [(None, "no id")]
    folder = shared_folder(spark, "t")
    token_store.write_tokens(docs(spark, rows).repartition(3), folder, PATH)
    got = token_store.read_tokens(spark, folder, with_ids=True).collect()
    lib, at = tokenizer(), 0
    by_start = sorted(got, key=lambda r: (r.start, r.n_tokens))
    assert [r.doc_id for r in by_start] == [None, *sorted(i for i, _ in rows if i is not None)]
    text = dict(rows)
    for r in by_start:
        ids = [*lib.encode(text[r.doc_id] or "", add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids) == (at, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    (one,) = token_store.read_document(folder, by_start[5].doc_id)
    assert one.tolist() == by_start[5].ids
    assert token_store.read_document(folder, 10_000) == []


def test_words_go_to_the_library_in_packs(monkeypatch):
    import tokenizers

    sent, library = [], tokenizer()

    class Counting:
        def __init__(self, path):
            self.own = library

        from_file = classmethod(lambda cls, path: cls(path))

        def __getattr__(self, name):
            return getattr(self.own, name)

        def encode_batch_fast(self, texts, **options):
            sent.extend(texts)
            return self.own.encode_batch_fast(texts, **options)

    monkeypatch.setattr(tokenizers, "Tokenizer", Counting)
    memo, width = token_store._encoder.__wrapped__(PATH)
    inner = ["\n", "\n\n", "\t", "\r\n", "\u2028", "\x85", "\x1c", "'s", "\u00a0", "-", "_", "9", "é", "漢", "🙂", "Ġ", "<|endoftext|>"]
    words = [f"{a}{i}{b}x" for i in range(40) for a in ["w", "", "É", "'", "\n", "Ġ"] for b in inner]
    text = "begin " + " ".join(words)
    (got,) = memo([text])
    assert np.frombuffer(got, f"<u{width}").tolist() == library.encode(text, add_special_tokens=False).ids
    sent.clear()
    plain = ["w" + w for w in words]
    got = memo(["begin " + " ".join(plain)])[0]
    assert np.frombuffer(got, f"<u{width}").tolist() == library.encode("begin " + " ".join(plain), add_special_tokens=False).ids
    assert len(sent) <= len(plain) / token_store.PACK + 2


def test_words_that_come_again_stay_known():
    asked = []

    def spaced(words):
        asked.extend(words)
        return [f" {w}".encode() for w in words]

    memo = WordMemo(lambda texts: [t.encode() for t in texts], spaced, words=40)
    texts = [" ".join(["x", "often", *(f"w{i}" for i in range(n, n + 15))]) for n in range(0, 600, 15)]
    assert [memo([t])[0] for t in texts] == [t.encode() for t in texts]
    assert asked.count("often") == 1 and len(memo.known) + len(memo.older) <= 2 * (40 // 2 + 17)


def test_other_dictionary_is_refused(spark):
    folder = shared_folder(spark, "t")
    (entry,) = token_store.write_tokens(docs(spark, [(1, "a b c")]), folder, PATH)
    with pytest.raises(ValueError):
        token_store.Shard(token_store.Reader(folder), entry["file"], b"another")


def test_no_documents_no_shards(spark):
    folder = shared_folder(spark, "t")
    assert token_store.write_tokens(docs(spark, []), folder, PATH) == []
    assert token_store.read_tokens(spark, folder).count() == 0


def test_heap_gives_the_next_group_to_the_least_loaded():
    units = [(7, "a"), (7, "b"), (6, "c"), (5, "d"), (4, "e"), (4, "f"), (3, "g")]
    placed = schedule = shards.schedule(units, 3)
    loads = Counter()
    for size, name in units:
        loads[placed[name]] += size
    assert max(loads.values()) - min(loads.values()) <= 3 and set(schedule.values()) == {0, 1, 2}


def test_shards_keep_groups_and_number_slots(spark):
    rows = [(i, prose(i % 300, 5 + i % 40)) for i in range(900)] + [(None, None), (1005, ""), (1005, ""), (1007, "hot")]
    rows += [(2000 + i, "hot copy of a text") for i in range(500)]
    frame = docs(spark, rows).withColumn("shard", F.lit("clash")).withColumn("digest", F.lit(1))
    got = shards.assign_shards(frame, 24).collect()
    assert len(got) == len(rows)
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    text = dict(rows)
    group, load, slots = defaultdict(set), Counter(), defaultdict(list)
    for r in got:
        assert r.size == len((text[r.doc_id] or "").encode()) + 8
        assert r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode())
        group[text[r.doc_id] or ""].add(r.shard)
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in group.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    hot = group["hot copy of a text"].pop()
    rest = [v for k, v in load.items() if k != hot]
    assert len(load) == 24 and max(rest) - min(rest) <= 0.1 * max(rest)


def test_shards_of_nothing(spark):
    assert shards.assign_shards(docs(spark, []), 24).count() == 0


PAGES = [
    (1, "https://www.Example.org:443/a?b=c#d", "x" * 100), (2, "http://user@blog.example.org", "x" * 100),
    (3, "https://blog.example.org/é b\tc", "short"), (4, None, "short"), (5, "ftp://h/x", None), (None, "http://n/", "y" * 200),
    (-6, "http://n/", "y" * 200), (7, "http://n/", "y" * 200), (7, "http://n/", "y" * 200), (8, "", "é" * 60),
]


def test_surt_keys():
    assert warc.surt("https://www.Example.org:443/a?b=c#d") == "org,example,www)/a?b=c"
    assert warc.surt("http://h?q") == "h)?q" and warc.surt(None) == "" and warc.surt("") == ""


@pytest.mark.parametrize("lines", [2, 3000])
def test_archives_round_trip(spark, lines):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    folder = shared_folder(spark, "w")
    captures = warc.write_archives(pages.repartition(3), folder)
    index = warc.write_index(captures, folder, lines)
    got = warc.lookup(captures.select("key"), index, folder).collect()
    html = {p: (h or "").encode() for p, _, h in PAGES}
    assert Counter(r.page_id for r in got) == Counter(p for p, _, _ in PAGES)
    first = {1: 1, 2: 1, None: -6, -6: -6, 7: -6}
    for r in got:
        assert r.payload_bytes == len(html[r.page_id])
        assert r.payload_digest == hashlib.sha256(html[r.page_id]).hexdigest()
        own = first.get(r.page_id, r.page_id)
        if own == r.page_id:
            assert (r.record_type, r.refers_to, bytes(r.payload)) == ("response", None, html[r.page_id])
        elif r.page_id is not None:
            assert (r.record_type, r.refers_to, r.payload) == ("revisit", own, None)
    asked = spark.createDataFrame([(warc.capture_key("http://n/", 7, "2024-01-01T00:00:00Z"),), ("none",)], "key string")
    assert [r.page_id for r in warc.lookup(asked, index, folder).collect()] == [7, 7]


def test_no_pages(spark):
    folder = shared_folder(spark, "w")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    captures = warc.write_archives(pages, folder)
    index = warc.write_index(captures, folder)
    assert warc.lookup(captures.select("key"), index, folder).count() == 0
