"""M5: batch text embedding with a caller-supplied encoder.

The encoder (e.g. an ONNX sentence encoder the caller ships to executors) is
built once per Python worker by ``encoder_factory()`` and applied to Arrow
batches of texts with ``mapInPandas`` - texts are never gathered on the
driver.  Without an encoder the pipeline consumes an existing embedding table
(``sources.files.load_embeddings``), and a method whose vectors are absent is
skipped (M11).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Encoder = Callable[[Sequence[str]], np.ndarray]

def encode_texts(df: DataFrame, encoder_factory: Callable[[], Encoder], id_col: str = "item_id",
                 text_col: str = "text", batch_size: int = 256) -> DataFrame:
    """``(item_id, embedding ARRAY<FLOAT>)`` for every row of ``df``."""
    def run(batches):
        enc = encoder_factory()
        for pdf in batches:
            for start in range(0, len(pdf), batch_size):
                part = pdf.iloc[start:start + batch_size]
                texts = part[text_col].fillna("").astype(str).tolist()
                vecs = np.asarray(enc(texts), dtype=np.float32)
                yield pd.DataFrame({"item_id": part[id_col].astype("int64").to_numpy(),
                                    "embedding": list(vecs)})

    return (df.select(df[id_col].alias(id_col), df[text_col].alias(text_col))
            .mapInPandas(run, "item_id long, embedding array<float>"))
