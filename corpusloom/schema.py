"""Relations of the corpus pipeline."""

from pyspark.sql import types as T

BOOK = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "title", "author", "genre", "source", "text")]
    + [T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))]
)
SENTENCE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("book_id", "title", "author", "genre", "text")]
    + [T.StructField("position", T.IntegerType()), T.StructField("created_at", T.TimestampType())]
)
EXAMPLE = T.StructType(
    [T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("input_ids", "attention_mask", "token_type_ids")]
    + [T.StructField("book_id", T.StringType()), T.StructField("genre", T.StringType())]
)
EPOCH_METRICS = "epoch int, train_loss double, val_loss double, val_perplexity double, learning_rate double, best_val_loss double, time_seconds double"
#: Ids of the special tokens, the first lines of every vocabulary.
SPECIALS = {"[PAD]": 0, "[UNK]": 1, "[CLS]": 2, "[SEP]": 3, "[MASK]": 4}
