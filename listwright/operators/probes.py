"""Words under which a text can be found, and fields as bits.

For one query or list of skills, texts are cut into words inside the row and only what shares a word runs a pattern. Tables
of queries and profiles use the positional index (``postings``).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Forms that cannot be looked up by a word are found under this one, which every text has.
NO_WORD = ""


# Words end at anything that is no letter or number. Digits behind a letter belong to the
# end, so 'python3' and 'k812' are looked up as 'python' and 'k'.
_WORD_END = r"(?:(?<=\p{L})\p{Nd}+)?(?:[^\p{L}\p{N}]+|$)"


def lookup_words(form: str) -> list[str]:
    """What a text that contains the form can be found under.

    A match starts with the first run of letters and digits of the form, to which one of the
    technical suffixes (s, es, js, digits) may have been added. A run of digits alone could
    be the beginning of any number, so it is looked for everywhere.
    """
    run = re.search(r"[^\W_]+", form.lower())
    if not run or run.group(0).isdecimal():
        return [NO_WORD]
    word = run.group(0)
    return [re.sub(r"(?<=[^\W\d_])\d+$", "", word), word + "s", word + "es", word + "js"]


def words_of(text: Column) -> Column:
    """Words of a text as they are looked up (with repetitions)."""
    # The blank in front makes NO_WORD the first word of every text.
    return F.split(F.concat(F.lit(" "), F.lower(text)), _WORD_END)


def field_mask(fields: dict[int, Column], matches) -> Column:
    """Sum of the bits of the fields for which ``matches(text)`` holds."""
    mask = F.lit(0)
    for bit, text in fields.items():
        mask = mask + F.when(matches(text), F.lit(bit)).otherwise(F.lit(0))
    return mask
