"""Reports P1-P9: pure ``DataFrame -> DataFrame`` functions, no actions, no writes."""

from halflife.plans.activity import active_lines, active_people  # noqa: F401
from halflife.plans.authors import author_change_rates, author_decay  # noqa: F401
from halflife.plans.cohort import cohort_decay, cohort_pairs, creation_gaps, weekly_decay  # noqa: F401
from halflife.plans.files import file_population, history_summary  # noqa: F401
from halflife.plans.people import distinct_people, merge_bitmaps, number_people, people_weeks, week_bitmaps  # noqa: F401
from halflife.plans.summary import LineSummary, merge_summaries, read_summary, write_summary  # noqa: F401
