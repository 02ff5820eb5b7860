"""Word frequencies and the lexical metrics of sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import exact_round
from ..functions.text import is_alpha, words

CONTENT = ("NOUN", "VERB", "ADJ", "ADV")


def word_rows(docs: DataFrame, lowercase: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, word): the alphabetic words of each text; "end." isn't one."""
    text = F.lower(text_col) if lowercase else F.col(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(words(text)).alias("pos", "word")).where(is_alpha(F.col("word")))


def corpus_frequencies(docs: DataFrame, lowercase: bool = True, min_freq: int = 1) -> DataFrame:
    """(word, freq) over all texts."""
    return word_rows(docs, lowercase).groupBy("word").agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") >= min_freq)


def top_words(docs: DataFrame, n: int = 50, min_freq: int = 2) -> DataFrame:
    """(doc_id, word, freq, rank): the n commonest words of each text; ties in order of first appearance."""
    counts = word_rows(docs).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("freq"), F.min("pos").alias("first")).where(F.col("freq") >= min_freq)
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("freq"), "first"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n).select("doc_id", "word", "freq", "rank")


def lexical_density(tokens: DataFrame) -> DataFrame:
    """Per sentence: tokens that aren't punctuation, content words among them, and their ratio (null without tokens)."""
    counts = tokens.groupBy("doc_id", "sent_id").agg(F.count_if(~F.col("is_punct")).alias("token_count"), F.count_if(~F.col("is_punct") & F.col("pos").isin(*CONTENT)).alias("content_count"))
    return counts.withColumn("lexical_density", F.try_divide(F.col("content_count").cast("double"), F.col("token_count").cast("double")))


def sentence_words(tokens: DataFrame) -> DataFrame:
    """(doc_id, sent_id, word, tok_ids, content): each sentence's distinct lower-case alphabetic words, where they stand, and how often as content words.

    The rows are found in place, and a word that every sentence holds costs a row for each, not for each token, when it meets the
    frequencies. A sentence without words has one row with a word that is no word, so that it isn't lost and is no hot key.
    """
    none = F.concat_ws(" ", F.lit("\u0000"), F.col("doc_id").cast("string"), F.col("sent_id").cast("string"))
    word = F.when(F.col("is_alpha"), F.lower("text"))
    x = tokens.withColumn("first", F.row_number().over(Window.partitionBy("doc_id", "sent_id").orderBy(F.col("is_alpha").desc(), "tok_id")) == 1)
    x = x.where(F.col("is_alpha") | F.col("first")).select("doc_id", "sent_id", F.coalesce(word, none).alias("word"), F.when(F.col("is_alpha"), F.col("tok_id")).alias("tok_id"), (F.col("is_alpha") & F.col("pos").isin(*CONTENT)).alias("content"))
    return x.groupBy("doc_id", "sent_id", "word").agg(F.collect_list("tok_id").alias("tok_ids"), F.count_if("content").alias("content"))


def information_content(tokens: DataFrame, freqs: DataFrame) -> DataFrame:
    """Per sentence: mean of -log(frequency) over its alphabetic tokens found in freqs (word, freq; raw counts), null if none, the values in order (ic_values), and how many."""
    met = sentence_words(tokens).join(freqs.where("freq > 0"), "word", "left")
    placed = F.transform("tok_ids", lambda t: F.struct(t.alias("tok_id"), (-F.log(F.col("freq").cast("double"))).alias("ic")))
    values = F.array_sort(F.flatten(F.collect_list(F.when(F.col("freq").isNotNull(), placed))))
    per = met.groupBy("doc_id", "sent_id").agg(F.transform(values, lambda s: s["ic"]).alias("ic_values"))
    mean = F.try_divide(F.aggregate("ic_values", F.lit(0.0), lambda a, x: a + x), F.size("ic_values"))
    return per.select("doc_id", "sent_id", mean.alias("information_content"), "ic_values", F.size("ic_values").cast("long").alias("ic_count"))


def cohesion(tokens: DataFrame) -> DataFrame:
    """Per sentence: how many distinct alphabetic lemmas, in lower case, it shares with the one before (null for the first), and its own."""
    lemmas = F.array_sort(F.collect_set(F.when(F.col("is_alpha"), F.lower("lemma"))))
    return with_overlap(tokens.groupBy("doc_id", "sent_id").agg(lemmas.alias("content_words")))


def with_overlap(rows: DataFrame) -> DataFrame:
    """rows (doc_id, sent_id, content_words, ...) with cohesion_overlap."""
    last = F.lag("content_words").over(Window.partitionBy("doc_id").orderBy("sent_id"))
    return rows.withColumn("cohesion_overlap", F.when(last.isNotNull(), F.size(F.array_intersect(last, "content_words"))))


def turn_overlap(turns: DataFrame) -> DataFrame:
    """Distinct words that each turn of a conversation shares with the one before."""
    own = F.array_distinct(F.filter(words(F.lower("text")), is_alpha))
    last = F.lag("own").over(Window.partitionBy("conv_id").orderBy("turn"))
    x = turns.select("conv_id", "turn", own.alias("own")).withColumn("overlap", F.when(last.isNotNull(), F.size(F.array_intersect(last, "own"))))
    return x.select("conv_id", "turn", F.col("overlap").cast("long").alias("overlap"))


def average_word_frequency(tokens: DataFrame, freqs: DataFrame) -> DataFrame:
    """Per sentence with alphabetic tokens: mean frequency of these (1 if unseen), that mean over the overall mean frequency, and content words per function word; to 3 places."""
    overall = F.broadcast(freqs.agg(F.avg("freq").alias("overall")))  # one row
    n = F.size("tok_ids").cast("long")
    x = sentence_words(tokens).join(freqs, "word", "left").groupBy("doc_id", "sent_id").agg(F.sum(F.coalesce("freq", F.lit(1)) * n).alias("total"), F.sum(n).alias("n"), F.sum("content").alias("content"))
    x = x.where("n > 0").withColumn("_mean", F.col("total").cast("double") / F.col("n")).crossJoin(overall)
    x = x.withColumn("_norm", F.try_divide(F.col("_mean"), F.col("overall"))).withColumn("_ratio", F.try_divide(F.col("content").cast("double"), (F.col("n") - F.col("content")).cast("double")))
    return x.select("doc_id", "sent_id", exact_round("_mean", 3).alias("avg_word_freq"), F.coalesce(exact_round("_norm", 3), F.lit(0.0)).alias("normalized_freq"), F.coalesce(exact_round("_ratio", 3), F.lit(0.0)).alias("content_function_ratio"))


def mattr(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, mattr): mean share of distinct words in all windows of so many words, to 3 places; the plain ratio for shorter texts; 0 without words."""
    w = docs.select("doc_id", F.filter(words(F.lower("text")), is_alpha).alias("w"))
    n = F.size("w")
    # moving window: a word is new in every window that it is in and its next occurrence isn't; so each occurrence counts for the windows that end before the next one
    pos = w.select("doc_id", F.posexplode_outer("w").alias("p", "word"), n.alias("n"))
    after = F.lead("p").over(Window.partitionBy("doc_id", "word").orderBy("p"))
    pos = pos.withColumn("next", F.when(F.col("word").isNotNull(), F.coalesce(after, F.col("n") + window)))
    # starts s of full windows with s <= p, p < s + window <= next: the last occurrence in its window
    low = F.greatest(F.col("p") - window + 1, F.lit(0))
    high = F.least(F.col("p"), F.col("n") - window, F.col("next") - window)
    whole = F.greatest(high - low + 1, F.lit(0))
    x = pos.groupBy("doc_id").agg(F.max("n").alias("n"), F.sum(whole).cast("double").alias("kinds"), F.count_if(F.col("next") >= F.col("n")).alias("distinct"))
    x = x.withColumn("_m", F.try_divide(F.col("kinds") / window, F.greatest(F.col("n") - window + 1, F.lit(0)).cast("double")))
    return x.select("doc_id", F.when(F.col("n") >= window, exact_round("_m", 3)).when(F.col("n") > 0, F.col("distinct") / F.col("n")).otherwise(F.lit(0.0)).alias("mattr"))
