"""Column functions: severities, masks, versions, identifiers, classifiers."""
