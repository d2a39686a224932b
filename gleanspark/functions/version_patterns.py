"""Patterns of versions by technology: fixed values."""

# Technology, method, pattern.
VERSION_PATTERNS = (
    ('angular', 'RUNTIME_CONSTANT', 'ng\\.version\\s*=\\s*["\\\']([\\d.]+(?:[-+][\\w.-]+)?)["\\\']'),
    ('angular', 'PACKAGE_IDENTIFIER', r"@angular/core@([\d.]+(?:[-+][\w.-]+)?)"),
    ('angular', 'BANNER', r"Angular\s+v?([\d.]+(?:[-+][\w.-]+)?)"),
    ('angular', 'BUILD_METADATA', '@angular/core[^"\\\']*["\\\']([\\d.]+(?:[-+][\\w.-]+)?)["\\\']'),
    ('bootstrap', 'BANNER', r"Bootstrap\s+v?([\d.]+(?:[-+][\w.-]+)?)"),
    ('bootstrap', 'PACKAGE_IDENTIFIER', r"bootstrap@([\d.]+(?:[-+][\w.-]+)?)"),
    ('bootstrap', 'METADATA', 'data-bs-version\\s*=\\s*["\\\']([\\d.]+(?:[-+][\\w.-]+)?)["\\\']'),
    ('jquery', 'RUNTIME_CONSTANT', 'jQuery\\.fn\\.jquery\\s*=\\s*["\\\']([\\d.]+(?:[-+][\\w.-]+)?)["\\\']'),
    ('jquery', 'PACKAGE_IDENTIFIER', r"jquery@([\d.]+(?:[-+][\w.-]+)?)"),
    ('jquery', 'BANNER', r"jQuery\s+v?([\d.]+(?:[-+][\w.-]+)?)"),
    ('jquery', 'FRAMEWORK_OBJECT', '\\$\\s*\\.\\s*fn\\s*\\.\\s*jquery\\s*=\\s*["\\\']([\\d.]+(?:[-+][\\w.-]+)?)["\\\']'),
    ('leaflet', 'RUNTIME_CONSTANT', 'Leaflet\\.version\\s*=\\s*["\\\']([\\d.]+(?:[-+][\\w.-]+)?)["\\\']'),
    ('leaflet', 'RUNTIME_CONSTANT', 'L\\.version\\s*=\\s*["\\\']([\\d.]+(?:[-+][\\w.-]+)?)["\\\']'),
    ('leaflet', 'PACKAGE_IDENTIFIER', r"leaflet@([\d.]+(?:[-+][\w.-]+)?)"),
    ('leaflet', 'BANNER', r"Leaflet\s+v?([\d.]+(?:[-+][\w.-]+)?)"),
    ('material-ui', 'PACKAGE_IDENTIFIER', r"@mui/material@([\d.]+(?:[-+][\w.-]+)?)"),
    ('material-ui', 'METADATA', r'"@mui/material"\s*:\s*"([\d.]+(?:[-+][\w.-]+)?)"'),
    ('material-ui', 'PACKAGE_IDENTIFIER', r"material-ui@([\d.]+(?:[-+][\w.-]+)?)"),
    ('material-ui', 'BANNER', r"Material[- ]UI\s+v?([\d.]+(?:[-+][\w.-]+)?)"),
    ('material-ui', 'BANNER', r"MUI\s+v?([\d.]+(?:[-+][\w.-]+)?)"),
    ('nextjs', 'RUNTIME_CONSTANT', r'window\.next=\{version:"([\d.]+(?:[-+][\w.-]+)?)"'),
    ('nextjs', 'RUNTIME_CONSTANT', r'window\.next\s*=\s*\{[^}]*version\s*:\s*"([\d.]+(?:[-+][\w.-]+)?)"'),
    ('nextjs', 'METADATA', r'"nextVersion"\s*:\s*"([\d.]+(?:[-+][\w.-]+)?)"'),
    ('nextjs', 'PACKAGE_IDENTIFIER', r"next@([\d.]+(?:[-+][\w.-]+)?)"),
    ('nextjs', 'BANNER', r"Next\.js\s+v?([\d.]+(?:[-+][\w.-]+)?)"),
    ('nextjs', 'BUILD_METADATA', r'"version"\s*:\s*"([\d.]+(?:[-+][\w.-]+)?)"[^}]*"next"'),
    ('react', 'RUNTIME_CONSTANT', 'React\\.version\\s*=\\s*["\\\']([\\d.]+(?:[-+][\\w.-]+)?)["\\\']'),
    ('react', 'RUNTIME_CONSTANT', r'reconcilerVersion\s*:\s*"([\d.]+(?:[-+][\w.-]+)?)"'),
    ('react', 'FRAMEWORK_OBJECT', r'version\s*:\s*"([\d.]+(?:[-+][\w.-]+)?)"[^}]*rendererPackageName\s*:\s*"react-dom"'),
    ('react', 'FRAMEWORK_OBJECT', r'rendererPackageName\s*:\s*"react-dom"[^}]*version\s*:\s*"([\d.]+(?:[-+][\w.-]+)?)"'),
    ('react', 'PACKAGE_IDENTIFIER', r"react(?:-dom)?@([\d.]+(?:[-+][\w.-]+)?)"),
    ('react', 'BANNER', r"React\s+v?([\d.]+(?:[-+][\w.-]+)?)"),
    ('react', 'BUILD_METADATA', '__VERSION__\\s*:\\s*["\\\']([\\d.]+(?:[-+][\\w.-]+)?)["\\\']'),
    ('tailwindcss', 'PACKAGE_IDENTIFIER', r"tailwindcss@([\d.]+(?:[-+][\w.-]+)?)"),
    ('tailwindcss', 'BANNER', r"Tailwind\s+CSS\s+v?([\d.]+(?:[-+][\w.-]+)?)"),
    ('tailwindcss', 'BUILD_METADATA', r"tailwindcss[/\s@]+([\d.]+(?:[-+][\w.-]+)?)"),
    ('turbopack', 'BANNER', r"turbopack[/\s@]+([\d.]+(?:[-+][\w.-]+)?)"),
    ('turbopack', 'PACKAGE_IDENTIFIER', r"turbopack@([\d.]+(?:[-+][\w.-]+)?)"),
    ('turbopack', 'FRAMEWORK_OBJECT', '__turbopack__[^"\\\']*["\\\']([\\d.]+(?:[-+][\\w.-]+)?)["\\\']'),
    ('vite', 'BANNER', r"vite[/\s@]+([\d.]+(?:[-+][\w.-]+)?)"),
    ('vite', 'PACKAGE_IDENTIFIER', r"vite@([\d.]+(?:[-+][\w.-]+)?)"),
    ('vite', 'FRAMEWORK_OBJECT', '__vite__[^"\\\']*["\\\']([\\d.]+(?:[-+][\\w.-]+)?)["\\\']'),
    ('vue', 'RUNTIME_CONSTANT', 'Vue\\.version\\s*=\\s*["\\\']([\\d.]+(?:[-+][\\w.-]+)?)["\\\']'),
    ('vue', 'PACKAGE_IDENTIFIER', r"vue@([\d.]+(?:[-+][\w.-]+)?)"),
    ('vue', 'BANNER', r"Vue\.js\s+v?([\d.]+(?:[-+][\w.-]+)?)"),
    ('vue', 'FRAMEWORK_OBJECT', '__VUE__[^"\\\']*["\\\']([\\d.]+(?:[-+][\\w.-]+)?)["\\\']'),
    ('webpack', 'BANNER', r"webpack[/\s]+([\d.]+(?:[-+][\w.-]+)?)"),
    ('webpack', 'PACKAGE_IDENTIFIER', r"webpack@([\d.]+(?:[-+][\w.-]+)?)"),
    ('webpack', 'BUILD_METADATA', '__webpack_require__\\.p\\s*\\+\\s*[\'\\"][^\'\\"]*webpack[^\'\\"]*([\\d.]+)'),
    ('webpack', 'PACKAGE_IDENTIFIER', r"webpack[-.]([\d.]+(?:[-+][\w.-]+)?)"),
)

# Weight of a method.
METHOD_WEIGHTS = {
    'RUNTIME_CONSTANT': 95.0,
    'FRAMEWORK_OBJECT': 92.0,
    'PACKAGE_IDENTIFIER': 90.0,
    'PACKAGE_MANIFEST': 89.0,
    'BUILD_METADATA': 88.0,
    'TECHNOLOGY_MARKER': 86.0,
    'METADATA': 85.0,
    'BANNER': 80.0,
    'SOURCE_MAP': 75.0,
    'ASSET_FILENAME': 70.0,
    'REFERENCE': 50.0,
    'GENERIC_LITERAL': 55.0,
    'UNKNOWN': 40.0,
}
