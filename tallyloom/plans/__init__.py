"""What ties operators together: schema catalog, view store, back-fill, reconciliation and the registered queries."""
