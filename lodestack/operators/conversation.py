"""Conversation: intent, topics, follow-ups, rewriting, deep reading, dialogue compaction, profile."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Phrases and words that decide an intent without a model.
PERSONAL = ["my name", "who am i", "do you know me", "do you remember me", "remember my name", "tell me about myself", "what do you know about me"]
GREETING = """hi hey hello yo sup howdy thanks thank thx ty bye goodbye ok okay cool nice alright sure yeah yep yes nope nah good morning afternoon evening
    night day see you ya later farewell greetings you? up what's there""".split()
ASKING = "what what's whats is are how how's hows it going".split()
DISCOURSE = r"(?i)^(?:so|well|and|now|but|then|hey|ok|okay|um|uh|hmm|btw|actually|anyway|alright|wait|please|hmm+|i\s+mean|like|y'?know)[\s,.!\-]+"
FACTUAL = (r"^(?:what(?:'?s| is| are| was| were)|who(?:'?s| is| are| was| were)|when(?:'?s| is| are| was| were)|where(?:'?s| is| are| was| were)|"
           r"why(?:'?s| is| are| was| were| does| do| did)|how(?:'?s| is| are| do(?:es)?| did| can| could| should| would)|which|define|defines|definition of|"
           r"explain|explains|explanation of|describe|describes|description of|summari[sz]e|summary of|tell me about|"
           r"give me (?:a )?(?:summary|overview|definition|explanation) of|check|show|list|find|get|compare|look (?:at|up)|search (?:for)?|"
           r"retrieve|fetch|walk me through|calculate|compute)\s+(?!(?:me\b|myself\b|my\s+(?:name|self)\b|i\b|i'?m\b))")
EDGE = "[.!?,:;\"'`~\\-]+"
BROAD = (r"(?i)\b(?:tell me (?:more |everything |all )?about|explain(?:\s+to me)?\b|give me (?:an? )?(?:overview|summary|rundown|breakdown|tour)|(?:an?\s+)?overview of|"
         r"walk me through|teach me(?:\s+about)?|i(?:'?d like| want| wanna| wish) to (?:learn|know|understand|read|hear) (?:more )?about|deep[\s-]?dive|dive into|"
         r"go deep(?:er)? (?:on|into)|everything (?:about|on|in)|break (?:it |this |that )?down|summari[sz]e|what(?:'?s| is| are|'?re) .{0,40}\b(?:about|cover|discuss))\b")
STRUCTURAL = (r"(?i)(?:how many (?:chapters|sections|parts|pages|volumes)|number of (?:chapters|sections|pages|parts|volumes)|table of contents|contents page|\btoc\b|"
              r"what (?:are|were) the (?:chapters|sections|parts)|list (?:the |all )?(?:chapters|sections|parts)|how (?:is|are) (?:it|the book|the document|the paper|the text|this) "
              r"(?:organi[sz]ed|structured|divided|laid out)|(?:overall )?structure of (?:the|this) (?:book|document|paper|text)|how long is (?:the|this) (?:book|document))")
STRUCTURAL_FA = ["چند فصل", "چند بخش", "چند صفحه", "چند قسمت", "فهرست مطالب", "فهرست", "ساختار کتاب", "ساختار سند", "تعداد فصل", "تعداد صفحات"]
WEAK = (r"(?i)(?:could ?n[o']?t find|could not find|does ?n[o']?t specify|do(?:es)? ?n[o']?t specify|does ?n[o']?t mention|do(?:es)? ?n[o']?t mention|"
        r"do ?n[o']?t have (?:enough )?information|no information|not specified|the passages (?:do not|do ?n[o']?t) (?:specify|mention|say))")
WEAK_FA = ["نمی‌دانم", "مشخص نشده", "اطلاعاتی ندارم"]
PRONOUNS = "it its this that they them these those".split()
FOLLOW = r"(?i)^\s*(tell me more|what about|how about|elaborate|continue|also|more details)\b"
MATH_META = r"(?i)\b(formula|formulae|equation|equations|math|maths|mathematical|derivation|theorem|proof|loss\s+function|objective\s+function)s?\b"
MATH_WORDS = "equation parameter θ Θ loss function objective gradient ∑ ∫ derivation variable"
TOPIC_STOP = """the and or of in on at to for by with from into onto upon than but not no yes a an this that these those some any all every each both few more most
    other such i me my mine myself you your yours yourself we us our ours ourselves he him his she her hers herself they them their theirs themselves it its itself
    is are was were be been being am has have had having do does did doing done will would should could can may might must shall ought what who when where why how
    which so well now then also very just only really ok okay yeah sure hey hi hello pdf md txt doc docx html htm xml ppt pptx paper draft version final rev
    appendix one two three four five six seven eight nine ten zero""".split()
POLARITY = {"fact": "Facts", "style": "Style", "like": "Likes", "dislike": "Dislikes"}


def normalized(question: Column) -> Column:
    q = T.strip(F.lower(F.coalesce(question, F.lit(""))))
    return F.regexp_replace(T.strip(F.regexp_replace(q, f"^{EDGE}|{EDGE}$", "")), r"(.)\1{2,}", "$1")


def _words(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, r"\s+"), lambda x: x != ""), lambda x: F.regexp_replace(x, f"{EDGE}$", ""))


def intent(question: Column) -> Column:
    """struct(intent, confidence) that needs no model; intent is null where one would have to decide."""
    q = normalized(question)
    bare = T.strip(F.regexp_replace(q, DISCOURSE, ""))
    words = _words(bare)
    every = lambda known: F.forall(words, lambda w: w.isin(*known))
    few = (F.size(words) > 0) & (F.size(words) <= 4)
    is_ = lambda name, sure: F.struct(F.lit(name).alias("intent"), F.lit(sure).alias("confidence"))
    return (F.when(~q.rlike(r"[\p{L}\p{N}]"), is_("unclear", 0.95)).when(reduce(lambda a, b: a | b, [F.contains(q, F.lit(p)) for p in PERSONAL]), is_("personal", 0.95))
            .when((F.size(words) > 1) & few & every(GREETING + ASKING), is_("greeting", 0.9)).when(bare.rlike(FACTUAL), is_("factual", 0.9))
            .when(few & every(GREETING), is_("greeting", 0.95)).otherwise(F.struct(F.lit(None).cast("string").alias("intent"), F.lit(None).cast("double").alias("confidence"))))


def is_broad(question: Column) -> Column:
    return (F.size(F.filter(F.split(question, r"\s+"), lambda x: x != "")) >= 3) & question.rlike(BROAD)


def is_structural(question: Column) -> Column:
    return reduce(lambda a, b: a | b, [question.rlike(STRUCTURAL), *[F.contains(question, F.lit(p)) for p in STRUCTURAL_FA]])


def is_weak(answer: Column) -> Column:
    return reduce(lambda a, b: a | b, [answer.rlike(WEAK), *[F.contains(answer, F.lit(p)) for p in WEAK_FA]])


def is_follow_up(question: Column) -> Column:
    """At most three words, an opener that continues, or a pronoun without its noun."""
    words = F.regexp_extract_all(F.lower(question), F.lit("([A-Za-z']+)"), 1)
    return (T.strip(question) != "") & ((F.size(words) <= 3) | question.rlike(FOLLOW) | F.exists(words, lambda w: w.isin(*PRONOUNS)))


def rewrite(messages: DataFrame) -> DataFrame:
    """(session_id, message_id, query) of user messages: a follow-up gets the user's last message in front, a question about mathematics its words behind."""
    w = Window.partitionBy("session_id").orderBy("message_id").rowsBetween(Window.unboundedPreceding, -1)
    said = F.when((F.col("role") == "user") & (T.strip(F.coalesce("content", F.lit(""))) != ""), T.strip("content"))
    rows = messages.withColumn("before", F.last(said, True).over(w)).filter("role = 'user'")
    q = F.when(F.col("before").isNotNull() & is_follow_up(F.col("content")), F.concat("before", F.lit("\n"), "content")).otherwise(F.col("content"))
    return rows.select("session_id", "message_id", F.when(q.rlike(MATH_META), F.concat(q, F.lit(" " + MATH_WORDS))).otherwise(q).alias("query"))


def topic_terms(docs: DataFrame, least: int = 3) -> DataFrame:
    """(user_id, term): the runs of ASCII letters in titles, lower-cased, without stop words and short ones; digits are no topics."""
    runs = F.transform(F.regexp_extract_all("title", F.lit("([A-Za-z]+)"), 1), F.lower)
    return docs.select("user_id", F.explode(runs).alias("term")).filter((F.length("term") >= least) & ~F.col("term").isin(*TOPIC_STOP)).distinct()


def known_topics(questions: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, topics): the title words that a question names as whole words."""
    words = questions.select("query_id", "user_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)(\w+)"), 1))).alias("term"))
    return words.join(terms, ["user_id", "term"], "left_semi").groupBy("query_id").agg(F.array_sort(F.collect_set("term")).alias("topics"))


def about_user(chunks: DataFrame, profile: DataFrame) -> DataFrame:
    """chunks that hold a word of four letters or more of their user's profile values."""
    words = profile.select("user_id", F.explode(F.regexp_extract_all(F.lower("value"), F.lit(r"(\p{L}{4,})"), 1)).alias("w")).groupBy("user_id").agg(F.collect_set("w").alias("__w"))
    return chunks.join(words, "user_id").filter(F.exists("__w", lambda w: F.contains(F.lower("text"), w))).drop("__w")


def parts(chunks: DataFrame, most: int = 10) -> DataFrame:
    """(doc_id, part, first, last, label): at most `most` contiguous ranges of a document's chunks of even length.

    Bounds are rounded half to even; a label is the first clean section label of the part, else its number.
    """
    n = chunks.groupBy("doc_id").agg((F.max("chunk_index") + 1).alias("n")).withColumn("k", F.least("n", F.lit(most)))
    cut = n.select("doc_id", "n", "k", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("part"))
    edge = lambda i: F.bround(i * F.col("n") / F.col("k")).cast("int")
    cut = cut.select("doc_id", "part", edge(F.col("part")).alias("first"), (edge(F.col("part") + 1) - 1).alias("last"))
    label = T.heading_label(F.col("section"))
    rows = chunks.select("doc_id", "chunk_index", F.when(label != "", label).alias("label"))
    named = cut.join(rows, "doc_id").filter(F.col("chunk_index").between(F.col("first"), F.col("last"))).groupBy("doc_id", "part").agg(F.min(F.when(F.col("label").isNotNull(), F.struct("chunk_index", "label")))["label"].alias("label"))
    return cut.join(named, ["doc_id", "part"], "left").withColumn("label", F.coalesce("label", F.concat(F.lit("Part "), (F.col("part") + 1).cast("string"))))


def read_part(chunks: DataFrame, wanted: DataFrame, seen: DataFrame, most: int = 12) -> DataFrame:
    """Chunks of wanted ranges (doc_id, first, last) that are not among seen (chunk_id), the first few of each range."""
    rows = chunks.join(wanted, "doc_id").filter(F.col("chunk_index").between(F.col("first"), F.col("last"))).join(seen.select("chunk_id"), "chunk_id", "left_anti")
    w = Window.partitionBy("doc_id", "first").orderBy("chunk_index")
    return rows.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= most).drop("__n", "first", "last")


def target_document(hits: DataFrame) -> DataFrame:
    """(query_id, doc_id): of the hits (query_id, doc_id, source_type, score, rerank) the document of most score that is no memory; ties by hits, then id."""
    s = F.sum(F.coalesce("rerank", "score"))
    by = hits.filter("source_type <> 'episodic'").groupBy("query_id", "doc_id").agg(F.round(s, 6).alias("s"), F.count("*").alias("n"))
    w = Window.partitionBy("query_id").orderBy(F.desc("s"), F.desc("n"), "doc_id")
    return by.withColumn("r", F.row_number().over(w)).filter("r = 1").select("query_id", "doc_id")


def compact(messages: DataFrame, keep: int = 6, longer: int = 12, alike: float = 0.55, dim: int = 256) -> DataFrame:
    """(session_id, cluster, message_ids): the old turns of long sessions, clustered in one pass by hashed words.

    Sessions of more than `longer` messages are compacted but for their last `keep`. A message joins the cluster of the greatest cosine above
    `alike` to its running mean, which is brought to length 1 at each step, else opens one; clusters are numbered by their oldest message.
    """
    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        from ..providers import hash_embedding

        pdf = pdf.sort_values("message_id")
        if len(pdf) <= longer:
            return pd.DataFrame({"session_id": [], "cluster": [], "message_ids": pd.Series([], dtype="object")})
        old, means, members = pdf.iloc[:-keep], [], []
        for i, text in zip(old["message_id"].tolist(), old["content"]):
            v = hash_embedding(text or "", dim)
            s = [float(v @ m) for m in means]
            j = int(np.argmax(s)) if s else -1
            if j >= 0 and s[j] > alike:
                mean = (means[j] * len(members[j]) + v) / (len(members[j]) + 1)
                means[j] = mean / (np.linalg.norm(mean) or 1)
                members[j].append(i)
            else:
                means.append(v)
                members.append([i])
        return pd.DataFrame({"session_id": pdf["session_id"].iloc[0], "cluster": range(len(members)), "message_ids": pd.Series(members, dtype="object")})

    kind = messages.schema["session_id"].dataType.simpleString()
    return messages.select("session_id", "message_id", "content").groupBy("session_id").applyInPandas(cluster, f"session_id {kind}, cluster int, message_ids array<long>")


def profile_text(profile: DataFrame, least: float = 0.5, most: int = 12) -> DataFrame:
    """(user_id, text): the surest preferences, one line a group."""
    w = Window.partitionBy("user_id").orderBy(F.desc("confidence"), "topic", "polarity")
    rows = profile.filter(F.col("confidence") >= least).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most)
    out = None
    for i, (key, title) in enumerate(POLARITY.items()):
        group = rows.filter(F.col("polarity") == key).groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "value"))), lambda x: x["value"]), "; ").alias("v"))
        group = group.select("user_id", F.lit(i).alias("i"), F.concat(F.lit(title + ": "), "v").alias("line"))
        out = group if out is None else out.unionByName(group)
    return out.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("text"))


def entities(text: Column) -> Column:
    """Names: capitalised ASCII words and words with letters beyond ASCII, three letters or more, in order of first sight."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)\b([A-Z][A-Za-z'\-]+|\p{L}{3,})\b"), 1)
    return F.array_distinct(F.filter(found, lambda w: w.rlike("^[A-Z]|[^\\x00-\\x7F]") & ~F.lower(w).isin(*T.STOP_EN)))


def tracked_entities(messages: DataFrame, most: int = 50) -> DataFrame:
    """(session_id, name): the latest distinct names of each session, the oldest dropped beyond the bound."""
    seen = messages.select("session_id", "message_id", F.posexplode(entities(F.col("content"))).alias("p", "name")).groupBy("session_id", "name").agg(F.max(F.struct("message_id", "p")).alias("at"))
    w = Window.partitionBy("session_id").orderBy(F.desc("at"))
    return seen.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most).select("session_id", "name")
