"""Patterns of evidence in JavaScript: fixed values."""

# Family, label, pattern.
JS_RUNTIME_PATTERNS = (
    ('react', 'ReactDOM.createRoot runtime call', r"\bReactDOM\.createRoot\b"),
    ('react', 'hydrateRoot runtime call', r"\bhydrateRoot\b"),
    ('react', 'React DevTools global hook', r"\b__REACT_DEVTOOLS_GLOBAL_HOOK__\b"),
    ('react', 'createContext runtime call', r"\bcreateContext\b"),
    ('react', 'useState hook reference', r"\buseState\b"),
    ('react', 'useEffect hook reference', r"\buseEffect\b"),
    ('vue', 'Vue.createApp runtime call', r"\bVue\.createApp\b"),
    ('vue', 'Vue global runtime marker', r"\b__VUE__\b"),
    ('angular', 'Angular Ivy defineComponent runtime', r"\bɵɵdefineComponent\b"),
    ('angular', 'zone.js runtime reference', r"\bzone\.js\b"),
    ('solid', 'Solid createSignal runtime', r"\bcreateSignal\b"),
    ('svelte', 'Svelte runtime component reference', r"\bSvelteComponent\b"),
    ('astro', 'Astro runtime reference', r"\bAstro\b"),
    ('next', 'Next.js runtime data marker', r"\b__NEXT_DATA__\b"),
    ('nuxt', 'Nuxt runtime data marker', r"\b__NUXT__\b"),
)

# Bundler, label, pattern.
JS_BUNDLE_PATTERNS = (
    ('webpack', 'Webpack runtime marker', '__webpack_require__|webpackChunk|webpackJsonp'),
    ('vite', 'Vite runtime marker', r"__vite__|import\.meta\.env"),
    ('rollup', 'Rollup runtime marker', r"rollupVersion|Rollup\b"),
    ('parcel', 'Parcel runtime marker', r"parcelRequire|Parcel\b"),
    ('rspack', 'Rspack runtime marker', '__rspack_require__'),
    ('turbopack', 'Turbopack runtime marker', 'turbopack|__turbopack__'),
)

# Technology, source, pattern.
JS_VERSION_PATTERNS = (
    ('react', 'runtime', 'React\\.version\\s*=\\s*["\\\']([\\d.]+(?:[-+][\\w.-]+)?)["\\\']'),
    ('react', 'package', r"react(?:-dom)?@([\d.]+(?:[-+][\w.-]+)?)"),
    ('vue', 'runtime', 'Vue\\.version\\s*=\\s*["\\\']([\\d.]+(?:[-+][\\w.-]+)?)["\\\']'),
    ('angular', 'runtime', 'ng\\.version\\s*=\\s*["\\\']([\\d.]+(?:[-+][\\w.-]+)?)["\\\']'),
    ('angular', 'package', r"@angular/core@([\d.]+(?:[-+][\w.-]+)?)"),
    ('nextjs', 'manifest', r'"nextVersion"\s*:\s*"([\d.]+(?:[-+][\w.-]+)?)"'),
    ('nextjs', 'package', r"next@([\d.]+(?:[-+][\w.-]+)?)"),
    ('nuxt', 'manifest', r'"nuxt"\s*:\s*"([\d.]+(?:[-+][\w.-]+)?)"'),
    ('webpack', 'banner', r"webpack[/\s]+([\d.]+(?:[-+][\w.-]+)?)"),
    ('vite', 'banner', r"vite[/\s@]+([\d.]+(?:[-+][\w.-]+)?)"),
    ('bootstrap', 'banner', r"Bootstrap\s+v?([\d.]+(?:[-+][\w.-]+)?)"),
    ('tailwindcss', 'package', r"tailwindcss[/\s@]+([\d.]+(?:[-+][\w.-]+)?)"),
    ('wordpress', 'banner', r"WordPress\s+([\d.]+(?:[-+][\w.-]+)?)"),
    ('laravel', 'banner', r"Laravel\s+v?([\d.]+(?:[-+][\w.-]+)?)"),
    ('django', 'banner', r"Django[/\s]+([\d.]+(?:[-+][\w.-]+)?)"),
)
