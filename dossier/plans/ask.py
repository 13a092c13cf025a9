"""Question answering: route, enrich, retrieve, ground, prompt and answer a batch of questions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.modeljson import parse_units
from dossier.functions.text import answer_halves, is_chinese, strip
from dossier.models import ChatModel, Embedder, chat, embed
from dossier.operators import match as M
from dossier.operators import retrieval as R
from dossier.operators.unnest import unnest_structs
from dossier.params import ENRICH_TERMS, RetrievalParams
from dossier.session import checkpoint

# Answers when nothing was found.
NO_DATA_EN = "Sorry, there is currently no relevant data in the database to answer this question."
NO_DATA_ZH = "抱歉，目前資料庫中尚無相關資料可供回答此問題。"


@dataclass
class Corpus:
    """Tables behind the answers; ``items``/``nodes`` are parents of the two chunk tables."""

    chunks: DataFrame
    items: DataFrame
    masters: DataFrame
    files: DataFrame
    knowledge_chunks: DataFrame | None = None
    nodes: DataFrame | None = None
    documents: DataFrame | None = None


def _as_said(text: Column) -> Column:
    return text


def translated(questions: DataFrame, patterns: DataFrame, model: ChatModel, script=_as_said) -> DataFrame:
    """Adds ``chinese``: the question itself, or its translation under the official terms in the form that ``script`` gives it."""
    hits = M.english_hits(questions, ["query_id"], "question", patterns)
    terms = hits.groupBy("query_id").agg(R.ordered_text(F.concat(F.lit("  - "), F.col("en"), F.lit(" → "), F.col("zh")), F.col("pos"), "\n").alias("terms"))
    rows = questions.join(terms, "query_id", "left")
    block = F.when(F.col("terms").isNotNull(), F.concat(F.lit("\n\nOfficial terms to use:\n"), F.col("terms"), F.lit("\n"))).otherwise("")
    prompt = F.concat(F.lit("Translate into Traditional Chinese. Give the translation only."), block, F.lit("\n\n"), F.col("question"))
    zh = rows.where(is_chinese(F.col("question"))).select("query_id", "question", F.col("question").alias("chinese"))
    other = rows.where(~F.coalesce(is_chinese(F.col("question")), F.lit(False)))
    other = other.select("query_id", "question", script(strip(F.coalesce(chat(prompt, model)["answer"], F.col("question")))).alias("chinese"))
    return zh.unionByName(other)


def to_english(texts: DataFrame, patterns: DataFrame, model: ChatModel) -> DataFrame:
    """(id, text, english): translation with the dictionary terms that occur in the text."""
    listed = dictionary_terms(texts.select("id", F.col("text").alias("t")), "id", "t", patterns)
    rows = texts.join(listed, "id", "left")
    none = F.array().cast("array<struct<pos:bigint,zh:string,en:string>>")
    prompt = F.concat(
        F.lit("You translate food export regulations into English.\n\n"), M.dictionary_xml(F.coalesce("terms", none)),
        F.lit("\n\n<Translation_Task>\nUse the exact English terms of the dictionary.\nSource text:\n"), F.col("text"), F.lit("\n</Translation_Task>"),
    )
    return rows.select("id", "text", strip(chat(prompt, model)["answer"]).alias("english"))


def dictionary_terms(texts: DataFrame, key: str, text: str | list[str], patterns: DataFrame, mode: str = "standard") -> DataFrame:
    """(key, terms): matched terms of a text in order; a text holds each dictionary term once.

    Several columns are read as one text, a line each; empty and null ones are left out before anything is normalised.
    """
    parts = [F.when(F.col(c) != "", F.col(c)) for c in ([text] if isinstance(text, str) else text)]
    norm = texts.select(key, M.normalize_for_matching(F.concat_ws("\n", *parts)).alias("__n"))
    hits = M.term_hits(norm, [key], "__n", patterns, mode)
    return hits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "zh", "en"))).alias("terms"))


def routed(questions: DataFrame, unit_patterns: DataFrame, profile: DataFrame | None, model: ChatModel | None, top_n: int) -> DataFrame:
    """(query_id, agency, unit, reason, rank, method): keyword matches, then the model for the rest.

    profile: (agency, unit, keywords, place), fewer than fifty rows.
    """
    first = M.classify(questions, ["query_id"], "chinese", unit_patterns, top_n)
    first = first.select("query_id", "agency", "unit", F.concat(F.lit("關鍵字比對到「"), F.col("keyword"), F.lit("」。")).alias("reason"), "rank", F.lit("keyword").alias("method"))
    if model is None or profile is None:
        return first
    line = F.concat(F.lit("機關："), F.col("agency"), F.lit(", 單位："), F.col("unit"), F.lit(", 分工關鍵字：["), F.col("keywords"), F.lit("]"))
    table = profile.agg(R.ordered_text(line, F.col("place"), "\n").alias("t")).scalar()
    short = questions.join(first.groupBy("query_id").agg(F.count("*").alias("have")), "query_id", "left").withColumn("have", F.coalesce("have", F.lit(0))).where(F.col("have") < top_n)
    prompt = F.concat(F.lit("Units and their keywords:\n"), table, F.lit("\n\nGive the responsible units as JSON in <JSON_Result> tags.\n<User_Query>"), F.col("chinese"), F.lit("</User_Query>"))
    said = short.withColumn("m", chat(prompt, model)).withColumn("u", parse_units(F.coalesce("m.answer", F.lit("")), top_n))
    extra = unnest_structs(said, ["query_id", "have"], "u", ["agency", "unit", "reason"], "k").where(F.col("k") < top_n - F.col("have"))
    extra = extra.join(first.select("query_id", "agency", "unit"), ["query_id", "agency", "unit"], "left_anti")
    extra = extra.select("query_id", "agency", "unit", "reason", (F.col("have") + F.col("k") + 1).cast("int").alias("rank"), F.lit("model").alias("method"))
    return first.unionByName(extra)


def route_label(routes: DataFrame) -> DataFrame:
    """(query_id, intent_method, agencies, units): none, the one method used, or hybrid."""
    names = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c)))), ", ")
    out = routes.groupBy("query_id").agg(F.collect_set("method").alias("ms"), names("agency").alias("agencies"), names("unit").alias("units"))
    label = F.when(F.size("ms") == 0, "none").when(F.size("ms") == 1, F.element_at("ms", 1)).otherwise("hybrid")
    return out.select("query_id", label.alias("intent_method"), "agencies", "units")


def qa_prompt(question: Column, context: Column, xml: Column, knowledge: Column) -> Column:
    block = F.when(F.coalesce(knowledge, F.lit("")) != "", F.concat(F.lit("<Knowledge_References>\n"), knowledge, F.lit("\n</Knowledge_References>")))
    parts = F.filter(
        F.array(
            F.concat(F.lit("<Historical_QA>\n"), F.coalesce(context, F.lit("")), F.lit("\n</Historical_QA>")), block, xml,
            F.concat(F.lit("<User_Query>\n"), question, F.lit("\n</User_Query>")),
            F.lit("Answer in English from the history with the exact dictionary terms, then a line ---, then the Traditional Chinese translation."),
        ),
        lambda p: p.isNotNull(),
    )
    return F.array_join(parts, "\n\n")


def ask(questions: DataFrame, corpus: Corpus, patterns: DataFrame, unit_patterns: DataFrame, embedder: Embedder, model: ChatModel,
        profile: DataFrame | None = None, params: RetrievalParams = RetrievalParams(), intent_top_n: int = 1, mode: str = "standard",
        translator: ChatModel | None = None, script=_as_said) -> dict[str, DataFrame]:
    """Answers, references, knowledge references, attachments and routes for (query_id, question).

    ``script`` is applied to every Chinese answer, for example ``functions.text.to_traditional``.
    """
    asked = checkpoint(translated(questions, patterns, translator or model, script))
    routes = routed(asked, unit_patterns, profile, model if profile is not None else None, intent_top_n)
    found = dictionary_terms(asked, "query_id", "chinese", patterns, mode)
    rows = asked.join(found, "query_id", "left")
    names = F.transform(F.coalesce("terms", F.array().cast("array<struct<pos:bigint,zh:string,en:string>>")), lambda t: t["zh"])
    rows = rows.withColumn("enriched", R.enriched_query(F.col("chinese"), names, ENRICH_TERMS))
    queries = checkpoint(embed(rows, "enriched", embedder, "query_vec")).select("query_id", "query_vec")
    first = R.track(corpus.chunks, queries, corpus.items, corpus.masters, params)
    if corpus.knowledge_chunks is not None:
        second = R.track(corpus.knowledge_chunks, queries, corpus.nodes, corpus.documents, params, tagged=False)
        qa, kb = R.merge_tracks(first, second, params)
    else:
        qa, kb = R.cap(first, params.top_n), None
    qa = checkpoint(qa)
    context = R.qa_context(qa)
    knowledge = R.knowledge_context(kb) if kb is not None else context.select("query_id", F.lit("").alias("knowledge_context")).where("false")
    full = asked.join(context, "query_id", "left").join(knowledge, "query_id", "left")
    full = full.withColumn("raw_context", F.coalesce("raw_context", F.lit("")))
    solid = M.grounded_terms(full, ["query_id"], "chinese", "raw_context", patterns, mode)
    listed = solid.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "zh", "en"))).alias("terms"))
    full = full.join(listed, "query_id", "left")
    xml = M.dictionary_xml(F.coalesce("terms", F.array().cast("array<struct<pos:bigint,zh:string,en:string>>")))
    empty = (F.col("raw_context") == "") & (F.coalesce("knowledge_context", F.lit("")) == "")
    ready = full.withColumn("prompt", F.when(~empty, qa_prompt(F.col("question"), F.col("raw_context"), xml, F.col("knowledge_context"))))
    said = ready.where(F.col("prompt").isNotNull()).withColumn("m", chat(F.col("prompt"), model)).withColumn("h", answer_halves(F.coalesce("m.answer", F.lit(""))))
    said = said.select("query_id", "question", "chinese", "raw_context", "prompt", F.col("h.english").alias("english"), script(F.col("h.chinese")).alias("chinese_answer"))
    blank = ready.where(F.col("prompt").isNull()).select("query_id", "question", "chinese", "raw_context", "prompt", F.lit(NO_DATA_EN).alias("english"), F.lit(NO_DATA_ZH).alias("chinese_answer"))
    out = {"answers": said.unionByName(blank), "routes": routes, "references": R.references(qa, ["master_id", "item_no"], ["master_name"]),
           "attachments": R.attachments(qa, corpus.files)}
    if kb is not None:
        out["knowledge_references"] = R.references(kb, ["master_id", "header_path"], ["doc_name", "doc_type"])
    return out
