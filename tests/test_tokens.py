"""Samples of a tokenizer file's ids against plain loops over the same tables."""

import collections

import pyarrow.parquet as pq
from tokenizers import Tokenizer

from voxweave.functions.tokenizing import public_vocabulary
from voxweave.plans import tokens

SF = "/root/testdata/sf0.001"


def rows(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


TOKENIZER = Tokenizer.from_file(public_vocabulary())
TOKENIZER.no_truncation()
TOKENIZER.no_padding()


def said(ids):
    return " ".join(map(str, ids))


def test_chunks(spark):
    want = {}
    for r in rows("documents"):
        ids = [*ids_of(r["text"]), tokens.END]
        for k, at in enumerate(range(0, len(ids), tokens.CHUNK)):
            want[r["doc_id"], k] = said(ids[at : at + tokens.CHUNK])
    got = {(r["doc_id"], r["chunk"]): r for r in tokens.tokenized_chunks(spark, SF).collect()}
    assert {k: r["input_ids"] for k, r in got.items()} == want and all(r["labels"] == r["input_ids"] for r in got.values())


def test_chat(spark):
    ids, labels = collections.defaultdict(list), collections.defaultdict(list)
    for r in sorted(rows("conversations"), key=lambda r: (r["conv_id"], r["turn"])):
        own = ids_of(f"<|im_start|>{r['role']}\n{r['text']}<|im_end|>\n")
        ids[r["conv_id"]] += own
        labels[r["conv_id"]] += own if r["role"] == "assistant" else [-100] * len(own)
    want = {k: (said(v[-tokens.TURNS :]), said(labels[k][-tokens.TURNS :])) for k, v in ids.items()}
    assert {r["conv_id"]: (r["input_ids"], r["labels"]) for r in tokens.tokenized_chat(spark, SF).collect()} == want


def test_classes(spark):
    quality = {r["doc_id"]: r["quality"] for r in rows("labels")}
    want = {}
    for r in rows("documents"):
        if r["doc_id"] in quality:
            ids = ids_of(r["text"])[: tokens.HEAD]
            want[r["doc_id"]] = (said(ids), said([*[-100] * (len(ids) - 1), quality[r["doc_id"]]] if ids else []))
    assert {r["doc_id"]: (r["input_ids"], r["labels"]) for r in tokens.tokenized_classes(spark, SF).collect()} == want
