"""Label scoring, miss attribution and agreement with reference scores."""
