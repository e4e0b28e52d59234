"""Calculation functions: every function takes and returns ``Column``.

Names follow the BI calculation language with a trailing underscore where the
plain name would shadow a Python builtin (``len_``, ``round_``, ``int_``...).
"""

from tessera.functions.strings import (  # noqa: F401
    ascii_, char, contains, startswith, endswith, find, findnth, left, right, mid, len_,
    lower, upper, proper, trim, ltrim, rtrim, replace, space, split, concat,
    combined_field, min2, max2,
)
from tessera.functions.regex import (  # noqa: F401
    regexp_match, regexp_extract, regexp_extract_nth, regexp_replace,
)
from tessera.functions.mathfn import (  # noqa: F401
    abs_, ceiling, floor, round_, round_fast, power, sqrt, square, log, ln, exp, sign, pi, sin, cos, tan,
    acos, asin, atan, cot, atan2, degrees, radians, div, mod, hexbinx, hexbiny,
)
from tessera.functions.dates import (  # noqa: F401
    dateadd, datediff, datename, dateparse, datepart, year, month, day, quarter, week,
    datetrunc, isdate, makedate, makedatetime, maketime, now, today, date_literal, week_start,
)
from tessera.functions.logic import (  # noqa: F401
    int_, float_, str_, date, datetime, case, if_, iif, ifnull, zn, isnull, isnumber,
    and_, or_, not_, eq, ne, in_, format_number,
)
from tessera.functions.spatial import makepoint, makeline, distance, area  # noqa: F401
