"""BPE encoding and decoding of whole texts, by the trie walk of ``bpe.TrieBpe``.

Null texts count as empty and have no ids. Repeated rows stay; other columns are not carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from vitrine.llm.bpe import encoder
from vitrine.llm.common import begin, keyed, unkeyed


def bpe_round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Each document's ids and what they decode to, as digests; ``keep`` adds both in ``ids`` and ``decoded``.

    ``tokenizer`` is the path of a file of the ``tokenizers`` library, readable on every executor."""
    given, kind = keyed(docs, id_col, text_col)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begin("encoding")
        coder = encoder(tokenizer)
        for batch in batches:
            out = []
            for key, raw in zip(batch["id"], coder.encode_batch(batch["text"].tolist()), strict=True):
                ids = np.frombuffer(raw, dtype=coder.kind)
                text = coder.decode(ids)
                row = (key, len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
                out.append((*row, ids.astype(np.int32), text) if keep else row)
            yield pd.DataFrame(out, columns=["id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if keep else [])])

    return unkeyed(given.mapInPandas(rows, "id string, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep), id_col, kind)
