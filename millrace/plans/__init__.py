"""Compositions: curation chain, dataset loading, rollout scoring, presets."""
