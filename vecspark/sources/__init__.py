"""Reading, splitting, generating and writing vector tables."""
