"""halflife: lifecycle and decay analytics on Spark DataFrames.

Items (code lines, files, slots, ...) are born at some time by a creator and
may die later by a remover.  The package turns such lifecycle tables, or git
patch logs replayed into them, into cohort decay, activity and population
reports.  Everything is expressed with the DataFrame API so Catalyst plans it
and the work runs distributed; only the per-file line replay is a grouped
pandas function.
"""

__version__ = "0.1.0"
