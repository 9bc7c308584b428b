"""Messages of a mail folder tree: strict parsing of headers and plain-text bodies.

MIME decoding has no built-in expression; it is an Arrow-batched UDF over the files'
bytes. Everything after it (subjects, quotes, shingles, fingerprints) is column code.
"""

from __future__ import annotations

import base64
import binascii
import email
import email.policy
import re
from email.header import decode_header

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from kinset.functions import hashing as H
from kinset.functions import text as T
from kinset.sources.readers import all_files

FIELDS = {"date": "Date", "from_header": "From", "to": "To", "cc": "Cc", "bcc": "Bcc", "subject": "Subject", "message_id": "Message-ID", "x_folder": "X-Folder", "x_origin": "X-Origin", "x_filename": "X-FileName"}
MESSAGE = StructType([StructField(n, StringType()) for n in (*FIELDS, "body", "error")])
_ALIASES = {"ansi_x3.4-1968": "ascii"}
_ENCODED = re.compile(r"=\?([^?\s]+)\?([bBqQ])\?([^?\s]*)\?=")


def _header(value: str | None) -> str:
    """An unfolded header with its encoded words decoded; a malformed one is an error."""
    text = re.sub(r"\r?\n[ \t]+", " ", value or "").strip()
    if "=?" in text and not _ENCODED.search(text):
        raise ValueError("malformed encoded word")
    parts = [(p.decode(_ALIASES.get((c or "ascii").lower(), c or "ascii"), "strict") if isinstance(p, bytes) else p) for p, c in decode_header(text)]
    return "".join(parts)


def _leaf(part: email.message.Message) -> str:
    encoding = (part.get("Content-Transfer-Encoding") or "7bit").strip().lower()
    payload = part.get_payload()
    raw = payload.encode("ascii", "surrogateescape") if isinstance(payload, str) else b""
    if encoding == "base64":
        try:
            raw = base64.b64decode(re.sub(rb"\s+", b"", raw), validate=True)
        except binascii.Error as e:
            raise ValueError("invalid base64") from e
    elif encoding == "quoted-printable":
        if re.search(rb"=(?![0-9A-Fa-f]{2}|[ \t]*\r?\n)", raw):
            raise ValueError("invalid quoted-printable")
        raw = binascii.a2b_qp(raw)
    elif encoding not in ("7bit", "8bit", "binary"):
        raise ValueError(f"unknown transfer encoding {encoding}")
    charset = (part.get_content_charset() or "ascii").lower()
    return raw.decode(_ALIASES.get(charset, charset), "strict")


def parse(content: bytes) -> dict[str, str | None]:
    """Headers and the plain-text leaves without attachments; error instead of a body."""
    out: dict[str, str | None] = dict.fromkeys([*FIELDS, "body", "error"])
    try:
        message = email.message_from_bytes(content, policy=email.policy.compat32)
        bad = [d for p in message.walk() for d in p.defects]
        if bad:
            raise ValueError(type(bad[0]).__name__)
        out.update({k: _header(message.get(h)) for k, h in FIELDS.items()})
        leaves = [p for p in message.walk() if p.get_content_type() == "text/plain" and not p.is_multipart() and not p.get_filename() and p.get_content_disposition() != "attachment"]
        out["body"] = "\n".join(_leaf(p) for p in leaves).replace("\r\n", "\n").replace("\r", "\n")
    except (ValueError, LookupError) as e:
        out["error"] = f"{type(e).__name__}: {e}"
    return out


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """(path, message fields.., body, error) of every file below folder."""

    @F.pandas_udf(MESSAGE)
    def parsed(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(c) for c in content], columns=MESSAGE.names)

    return all_files(spark, folder).select("path", parsed("content").alias("m")).select("path", "m.*")


def candidates(mail: DataFrame) -> DataFrame:
    """Well-formed messages as (path, record_id, fingerprint, message_id, subject, n_tokens, features).

    The fingerprint is over the envelope and the body with its quotes; tokens and features
    are of the body without them.
    """
    body = T.without_quotes(F.col("body"))
    words = T.tokens(T.folded_ascii(body))
    envelope = [F.coalesce(c, F.lit("")) for c in ("date", "from_header", "to", "cc", "bcc", "subject", "body")]
    features = F.array_sort(F.array_distinct(F.transform(T.shingles(words), lambda s: H.feature_hash(s))))
    return mail.where("error IS NULL").select(
        "path",
        H.digest_record_id(F.col("path"), "mail:").alias("record_id"),
        H.copy_fingerprint(*envelope).alias("fingerprint"),
        T.message_id(F.col("message_id")).alias("message_id"),
        T.canonical_subject(F.coalesce("subject", F.lit(""))).alias("subject"),
        F.size(words).cast("bigint").alias("n_tokens"),
        features.alias("features"),
    )
