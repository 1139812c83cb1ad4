"""leafmark: learn, check and repair page selectors over large tables of crawled pages.

Every step is a DataFrame operation keyed by ``page_id``; see the README for the plan shapes.
"""
