"""Message operators: cleaning, links, prompts, language, threads, headers.

Everything but ``latest_in_thread`` is a projection over the message table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lurelake import params as P
from lurelake.functions import text as T
from lurelake.functions.arrays import contained_words, exploded

TEXT_ALIASES = {
    "text": ("text", "Text"),
    "Subject": ("subject", "Subject", "email_subject", "title"),
    "Sender": ("sender", "Sender", "from", "From", "from_email"),
    "Body": ("body", "Body", "content", "Content", "email_body"),
    "Message": ("message", "Message", "sms", "SMS"),
    "URL": ("url", "URL", "urls", "URLs", "link", "links", "href"),
    "Attachment": ("attachment", "attachments", "filename", "file_name"),
}


def strip_zero_width(df: DataFrame, col: str = "body") -> DataFrame:
    return df.withColumn("clean_text", T.strip_zero_width(F.col(col)))


def nfkc_normalize(df: DataFrame, col: str = "body") -> DataFrame:
    """NFKC form; only rows with a non-ASCII character visit Python (no built-in exists)."""
    plain = ~F.col(col).rlike(r"[^\x00-\x7F]")
    needs = F.when(~plain, F.col(col))
    return df.withColumn("_u", T.nfkc(needs)).withColumn(
        "nfkc", F.coalesce(F.col("_u"), F.col(col))).drop("_u")


def sender_address(df: DataFrame, col: str = "sender") -> DataFrame:
    return df.withColumn("address", T.sender_address(F.col(col)))


def extract_urls(df: DataFrame, id_col: str = "msg_id", text_col: str = "text") -> DataFrame:
    """Long table of the links of each text: (id, pos, url, raw_url)."""
    links = df.select(id_col, T.extract_links(F.col(text_col)).alias("_links"))
    return exploded(links, id_col, "_links").select(
        id_col, "pos", F.col("item.norm").alias("url"), F.col("item.raw").alias("raw_url"))


def collapse_whitespace(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, T.collapse_whitespace(F.col(col)))


def truncate_at_word(df: DataFrame, col: str, limit: int) -> DataFrame:
    return df.withColumn(col, T.truncate_at_word(F.col(col), limit))


def prepared_fields(df: DataFrame) -> DataFrame:
    """subject, sender, body and attachment as the model sees them."""
    attachment = F.col("attachment") if "attachment" in df.columns else F.lit("")
    subject = F.when(F.col("message_type") == "sms", F.lit("")).otherwise(
        T.prepared(F.col("subject"), P.SUBJECT_CHARS))
    return df.withColumns({
        "subject": subject,
        "sender": T.prepared(F.col("sender")),
        "body": T.prepared(F.col("body"), P.BODY_CHARS),
        "attachment": T.prepared(attachment, P.ATTACHMENT_CHARS),
    })


def mask_links(df: DataFrame) -> DataFrame:
    """Replace every link by [LINK_n], one counter running over the four fields.

    Token arrays are found once per field; the offsets are array sizes, so the shared
    counter needs no ordering across rows and no state.
    """
    fields = ("subject", "sender", "body", "attachment")
    out = df
    for f in fields:
        out = out.withColumn(f"_t_{f}", T.link_tokens(F.col(f)))
    before = F.lit(0)
    masked, metadata = {}, []

    def described(field, start):
        return lambda t, i: F.struct(
            F.lit(field).alias("field"),
            T.split_link_token(t)["url"].alias("url"),
            F.concat(F.lit("[LINK_"), (start + i + 1).cast("string"), F.lit("]"))
            .alias("placeholder"),
        )

    for f in fields:
        tokens = F.col(f"_t_{f}")
        masked[f"{f}_masked"] = T.masked_text(F.col(f), tokens, before)
        metadata.append(F.transform(tokens, described(f, before)))
        before = before + F.size(tokens)
    out = out.withColumns(masked).withColumn("link_metadata", F.concat(*metadata))
    return out.drop(*[f"_t_{f}" for f in fields])


def link_table(masked: DataFrame, id_col: str = "msg_id") -> DataFrame:
    """Long table of the masked links: (id, field, url, placeholder)."""
    return exploded(masked, id_col, "link_metadata").select(id_col, "item.*")


def build_prompt(df: DataFrame) -> DataFrame:
    """Prompt of prepared or masked fields (subject_masked etc. are used when present)."""
    def field(name):
        c = f"{name}_masked" if f"{name}_masked" in df.columns else name
        return F.col(c) if c in df.columns else F.lit("")

    return df.withColumn("prompt", T.prompt(
        field("subject"), field("sender"), field("body"), field("attachment"),
        F.col("message_type") == "sms"))


def build_text(df: DataFrame, aliases=TEXT_ALIASES) -> DataFrame:
    """A text column from a direct text or from labelled parts under any known alias."""
    def first(names):
        present = [F.trim(F.col(c).cast("string")) for c in names if c in df.columns]
        filled = [F.when(c != "", c) for c in present]
        return F.coalesce(*filled) if filled else F.lit(None).cast("string")

    parts = [F.concat(F.lit(f"{label}: "), first(names))
             for label, names in aliases.items() if label != "text"]
    return df.withColumn("built_text", F.coalesce(
        first(aliases["text"]), F.trim(F.concat_ws("\n", *parts))))


def detect_language(df: DataFrame, col: str = "text") -> DataFrame:
    return df.withColumn("language", T.detect_language(F.col(col)))


def stop_word_language(df: DataFrame, words: dict[str, tuple[str, ...]], col: str = "text",
                       default: str = "EN") -> DataFrame:
    """Language whose stop words occur most often; ties go to the first, none to the default."""
    counts = F.array(*[F.struct(T.word_hits(F.col(col), ws).alias("n"), F.lit(-i).alias("p"),
                                F.lit(name).alias("lang"))
                       for i, (name, ws) in enumerate(words.items())])
    top = F.array_max(counts)
    return df.withColumn("language", F.when(top["n"] > 0, top["lang"]).otherwise(F.lit(default)))


def latest_in_thread(df: DataFrame, thread: str = "conv_id", order: str = "turn") -> DataFrame:
    """Last message of each thread; an aggregate, so long threads shrink before the shuffle."""
    rest = [c for c in df.columns if c != thread]
    return df.groupBy(thread).agg(
        F.max_by(F.struct(*rest), F.col(order)).alias("m")).select(thread, "m.*")


def route_channel(df: DataFrame, host_col: str = "host", title_col: str = "title") -> DataFrame:
    """Message type and subject by the host a message was read on."""
    h, t = F.col(host_col), F.col(title_col)

    def on(*names):
        test = F.lit(False)
        for n in names:
            test = test | h.contains(n)
        return test

    gmail = on("mail.google.com", "gmail.com")
    outlook = on("outlook", "office.com", "office365")
    texts = on("messages.google.com")
    social = on("facebook.com", "messenger.com")
    kind = (F.when(gmail | outlook, F.lit("email")).when(texts | social, F.lit("sms"))
            .otherwise(F.lit("email")))
    subject = (
        F.when(gmail, F.trim(F.regexp_replace(t, " - Gmail", "")))
        .when(outlook, F.trim(F.regexp_replace(t, " - Outlook", "")))
        .when(texts, F.lit("SMS Message")).otherwise(t)
    )
    return df.withColumns({"message_type": kind, "subject": subject})


def keyword_hits(df: DataFrame, text_cols=("subject", "body"),
                 sensitive=P.SENSITIVE_KEYWORDS, urgency=P.URGENCY_KEYWORDS) -> DataFrame:
    """Sorted contained keywords; the shown texts take the first 12 and 10."""
    out = df.withColumn("_low", F.lower(F.concat_ws("\n", *text_cols)))
    out = out.withColumns({
        "sensitive_hits": contained_words(F.col("_low"), sensitive),
        "urgency_hits": contained_words(F.col("_low"), urgency),
    })
    return out.withColumns({
        "sensitive_shown": F.array_join(F.slice("sensitive_hits", 1, 12), ", "),
        "urgency_shown": F.array_join(F.slice("urgency_hits", 1, 10), ", "),
    }).drop("_low")


def auth_status(df: DataFrame, col: str = "headers") -> DataFrame:
    return df.withColumns({k: T.auth_status(F.col(col), k) for k in ("spf", "dkim", "dmarc")})


def header_domains(df: DataFrame, col: str = "headers", suffixes=P.PUBLIC_SUFFIXES) -> DataFrame:
    names = {"return_path_domain": "Return-Path", "from_domain": "From",
             "reply_to_domain": "Reply-To", "message_id_domain": "Message-ID"}
    return df.withColumns({k: T.header_domain(F.col(col), v, suffixes) for k, v in names.items()})
