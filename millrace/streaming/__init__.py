"""The dialect over unbounded tables."""
