"""Imports every query module so their ``@query`` decorators run."""

from docket.plans import q_cases  # noqa: F401
from docket.plans import q_strings  # noqa: F401
from docket.plans import q_records  # noqa: F401
from docket.plans import q_joins  # noqa: F401
from docket.plans import q_aggs  # noqa: F401
from docket.plans import q_splits  # noqa: F401
from docket.plans import q_metrics  # noqa: F401
from docket.plans import q_tokens  # noqa: F401
from docket.plans import q_augment  # noqa: F401
from docket.plans import q_io  # noqa: F401
from docket.plans import q_ml_stream  # noqa: F401
