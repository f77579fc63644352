from .numeric import (abs_diff, answer_text, ascii_digits, coerce_numeric, int_token,  # noqa: F401
                      mean_of_two, rint_round)
from .scoring import (expected_rating, gated, integer_answer, live_expected_rating,  # noqa: F401
                      numeric_alternatives, one_token, softmax_topk, token_bytes)
from .text import (LOCALES, as_text, cell_label, column_placeholder, fill_template,  # noqa: F401
                   first_char_int, first_quoted, last_quoted, missing_or_blank,
                   number_from_answer, partial_template, placeholder_key, sentinel,
                   short_name, word_from_answer, json_field)
