"""Named thresholds.  Money is in cents, as everywhere inside the library."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    reconcile_tolerance: int = 100
    od_vote_tolerance: int = 2
    dr_suffix_share: float = 0.5
    negative_share: float = 0.5
    row_match_share: float = 0.9
    round_multiple: int = 1_000_000
    round_minimum: int = 1_000_000
    large_credit: int = 10_000_000
    high_value_times: int = 3
    low_closing: int = 100_000
    od_utilisation_pct: int = 90
    epf_bands: tuple = ((11, 15), (20, 26))
    socso_band: tuple = (1, 5)
    structural_run: int = 4
    subthreshold_salary: int = 3_000_000
    channel_blind_amount: int = 50_000_000
    channel_blind_pct: int = 10
    return_business_days: int = 5
    return_tolerance: int = 1
    unclassified_listing: int = 1_000_000
    outlier_window: int = 150_000_000
    outlier_least_rows: int = 10
    salary_recipient_pct: int = 50
    rp_concentration_pct: int = 5
    rp_recurrence_months: int = 3
    rp_round: int = 10_000
    rp_round_minimum: int = 100_000
    holidays: tuple = field(default=())


DEFAULT = Settings()
