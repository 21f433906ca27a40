"""The four ways a rating request has been served, as settings of one plan."""

from dataclasses import dataclass, replace

from tiltscale.fixed_values import DEFAULT_MODEL, DEFAULT_TEMPERATURE, FETCH_FAILED


@dataclass(frozen=True)
class Profile:
    name: str
    default_model: str | None  # for a request without the key
    default_temperature: float
    temperature_in_request: bool
    empty_url_is_missing: bool  # null or empty URL: refused, or a failed fetch
    strict_www: bool
    drop_empty_blocks: bool
    reject_blank: bool  # refuse an article without text
    own_timeout: bool  # a timed-out fetch has its own status
    fetch_error_prefix: str
    template: str
    source_in_answer: bool
    error_details: bool  # failures past the fetch say why


# Answer at once; published errors carry their cause.
SYNC = Profile(
    name="sync",
    default_model=DEFAULT_MODEL,
    default_temperature=DEFAULT_TEMPERATURE,
    temperature_in_request=True,
    empty_url_is_missing=False,
    strict_www=False,
    drop_empty_blocks=False,
    reject_blank=False,
    own_timeout=False,
    fetch_error_prefix=FETCH_FAILED,
    template="detailed",
    source_in_answer=True,
    error_details=True,
)

# Acknowledge, publish the article, rate later.
ASYNC = replace(
    SYNC,
    name="async",
    temperature_in_request=False,
    empty_url_is_missing=True,
    drop_empty_blocks=True,
    reject_blank=True,
    own_timeout=True,
    fetch_error_prefix="",
    template="brief",
)

# The earlier forms of both: no default model, publishers only with their www.
LEGACY_SYNC = replace(
    SYNC,
    name="legacy_sync",
    default_model=None,
    temperature_in_request=False,
    empty_url_is_missing=True,
    strict_www=True,
    fetch_error_prefix="",
    template="detailed_legacy",
    source_in_answer=False,
    error_details=False,
)
LEGACY_ASYNC = replace(LEGACY_SYNC, name="legacy_async", template="brief")

PROFILES = {profile.name: profile for profile in (SYNC, ASYNC, LEGACY_SYNC, LEGACY_ASYNC)}
