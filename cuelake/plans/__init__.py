"""Rewrites that Catalyst doesn't plan by itself: islands, interval joins, group folds."""
