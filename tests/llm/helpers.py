from __future__ import annotations

PATHS = {"byte": "/opt/tokenizers/byte_bpe_50k.json", "word": "/opt/tokenizers/word_bpe_49k.json"}
ODD = [
    None, "", " ", "'s", "it's 's  's\n's", "  a", "a  ", "a \n b", "x're 've 'll'd'dx", "<|endoftext|> hi <|endoftext|>", "Ünïcode ÀÉ don't ’s", "İstanbul ΣΑΣ",
    "é combining", "日本語 テスト １２３", "12 345  67", "\"'s ''s", "' s", "'", "a 't b", "\x1c a\x85b", "😀😀 's", "͸ un", "same text", "same text",
]


def docs_of(spark, texts, first=0):
    """Documents with a further column whose name clashes with names inside the operators."""
    rows = [(first + i, t, "en", "src0", len(t or ""), "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, cls string")
