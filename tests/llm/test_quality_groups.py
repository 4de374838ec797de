"""Small groups are judged by all rows of their language, or by all rows."""

import numpy as np
import pandas as pd

from fundcat.llm import quality


def _stats(n, lang, source, first, symbols=0):
    words = 50 + np.arange(n) * 7 % 850
    chars = (words * (4.5 + np.arange(n) % 11 / 10)).astype(int)
    return pd.DataFrame({"doc_id": first + np.arange(n), "lang": lang, "source": source, "n_words": words, "word_chars": chars, "n_symbols": chars * symbols // 100, "n_dup_lines": 0, "n_repeat_words": 0, "base_failed": False})


def test_small_groups_use_all_rows_of_the_wider_group(spark):
    rows = pd.concat([_stats(300, "en", "big", 0), _stats(1, "en", "junk", 1000, 90), _stats(1, "en", "clean", 1001), _stats(30, "en", "junk30", 1100, 90), _stats(1, "fr", "junk", 1200, 90), _stats(1, "fr", "clean", 1201)])
    out = quality.robust_distances(spark.createDataFrame(rows)).toPandas().set_index("doc_id").sort_index()
    assert len(out) == len(rows) and out.index.is_unique
    kept = out.d2 <= quality.chi2_quantile(1 - quality.ALPHA, len(quality.FEATURES))
    assert not kept[1000] and not kept[1200] and not kept.loc[1100:1129].any()
    assert kept[1001] and kept[1201] and kept.loc[:299].all()


def test_large_groups_are_as_alone(spark):
    big = _stats(300, "en", "big", 0)
    alone = quality.robust_distances(spark.createDataFrame(big)).toPandas().set_index("doc_id").d2
    beside = quality.robust_distances(spark.createDataFrame(pd.concat([big, _stats(3, "en", "small", 1000, 50)]))).toPandas().set_index("doc_id").d2
    assert np.allclose(alone.sort_index(), beside.loc[alone.index].sort_index())
