"""Intentionally empty: every job of this engine is a monthly batch.

"Rolling" protocols refit on a growing calendar (see ``plans.jobs``); no
watermark, session or stateful stream operator is part of the feature set.
"""
