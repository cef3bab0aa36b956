"""Operations of a training-data pipeline (corpus filtering, dedup, tokenizing, packing, search)."""
