"""Details of log lines, which are JSON of any shape: secrets taken out, size bounded. Runs in Python over Arrow batches, one text at a time, without recursion."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SECRETS

#: Names of secrets, what stands for them, the longest text, the deepest nesting, the most items.
SECRET_NAME = re.compile(r"(^|_|-)(api[-_]?key|secret|password|passwd|token|authorization|cookie|credentials?)($|_|-)|^key$", re.I)
REDACTED, TOO_DEEP = "[redacted]", "[too deep]"
LONGEST, DEEPEST, MOST = 4000, 6, 100
_SECRET = re.compile(SECRETS)


def scrubbed_text(text: str) -> str:
    clean = _SECRET.sub(REDACTED, text)
    return clean if len(clean) <= LONGEST else f"{clean[:LONGEST]}… ({len(clean) - LONGEST} more characters)"


def scrubbed(text: str | None) -> str | None:
    """The JSON text without secrets and within bounds; null for no JSON, or nesting that no parser takes. Places still to be looked at wait in a list, with their depth."""
    try:
        whole = [json.loads(text or "")]
    except (ValueError, RecursionError):
        return None
    places = [(whole, 0, 0)]
    while places:
        holder, at, depth = places.pop()
        value = holder[at]
        if isinstance(value, str):
            holder[at] = scrubbed_text(value)
        elif isinstance(value, (list, dict)) and depth >= DEEPEST:
            holder[at] = TOO_DEEP
        elif isinstance(value, list):
            holder[at] = value[:MOST] + ([f"… {len(value) - MOST} more"] if len(value) > MOST else [])
            places += [(holder[at], i, depth + 1) for i in range(min(MOST, len(value)))]
        elif isinstance(value, dict):
            holder[at] = kept = dict(list(value.items())[:MOST])
            for name, x in kept.items():
                if SECRET_NAME.search(name) and isinstance(x, (str, list, dict)):
                    kept[name] = REDACTED
                else:
                    places.append((kept, name, depth + 1))
    return json.dumps(whole[0], ensure_ascii=False, separators=(",", ":"))


def redacted_details(text: Column) -> Column:
    def scrub(texts: pd.Series) -> pd.Series:
        return texts.map(scrubbed)

    return F.pandas_udf(scrub, "string")(text)
